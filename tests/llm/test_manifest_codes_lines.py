"""Merkle manifests, vector codes and line rules on messy tables, against brute
force written another way."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import codes, lines, merkle

DOC_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, grp string, at long, part int, hash binary, n_words string, kept boolean, level int"


def documents(n: int = 140, seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(["wort", "Éa", "x.", "y", "漢字"]) for _ in range(k))
    rows = [(i, "\n".join(text(rng.randint(0, 9)) for _ in range(rng.randint(1, 4))), rng.choice(["en", None]), rng.choice(["hot", "hot", "hot", "b", "ä", "", None]), rng.choice([None, 0, 12])) for i in range(n)]
    rows += [(None, "no id", "en", "hot", 5), (None, None, None, None, None), (3, "same id", "en", "hot", 7), (3, "same id", "en", "hot", 7), (900, "", "en", "lone", 0), (901, text(30_000) + "\n", "en", "b", 1)]
    rows += [(902, "copy\n", "de", "hot", 5)] * 20
    rng.shuffle(rows)
    return [(*r, "g", 1, 2, b"h", "w", True, 3) for r in rows]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def layers(row: list[str]) -> list[list[str]]:
    out = [row]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def way(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for row in tree[:-1]:
        run = row[i // 3 * 3 : i // 3 * 3 + 3]
        out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return out


def leaf(r: tuple, text: str | None) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def proved(rows: list[tuple]) -> Counter:
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row."""
    by = defaultdict(list)
    for r in rows:
        tampered = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, r[1].replace("\n", "") if tampered else r[1]), r[0]))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: layers([x[2] for x in sorted(by[s])]) for s in sources}
    top, out = layers([trees[s][-1][0] for s in sources]), Counter()
    for k, s in enumerate(sources):
        for i, (_, _, own, now, doc) in enumerate(sorted(by[s])):
            path = [*way(trees[s], i), *way(top, k)]
            got = now
            for a, b in path:
                got = sha(a + got + b)
            out[doc, own, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), got, got == top[-1][0]] += 1
    return out


def tampered():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


@pytest.mark.parametrize("rows_each", [None, 7])
def test_manifest_against_whole_trees(spark, monkeypatch, rows_each):
    """Also with many ranges to a source, so that peaks meet in rounds of blocks."""
    if rows_each:
        for name, value in (("ROWS", rows_each), ("LEAST_ROWS", 1), ("RISE", 1), ("MORE_RISE", 1)):
            monkeypatch.setattr(merkle, name, value)
    rows = documents()
    found = merkle.manifest(spark.createDataFrame(rows, DOC_COLUMNS).repartition(3), text_now=tampered())
    assert len(found.documents.rounds) == (0 if rows_each is None else len(found.documents.rounds))
    if rows_each:
        assert len(found.documents.rounds) >= 2
    got = merkle.proofs(found)
    assert Counter(map(tuple, got.collect())) == proved(rows)
    assert any(not r.verified for r in got.collect())


def test_manifest_of_few_and_no_rows(spark):
    assert merkle.proofs(merkle.manifest(spark.createDataFrame([], DOC_COLUMNS))).collect() == []
    one = [(1, None, None, None, None, "g", 1, 2, b"h", "w", True, 3)]
    r = merkle.proofs(merkle.manifest(spark.createDataFrame(one, DOC_COLUMNS))).first()
    assert r.leaf == r.subroot == r.root == r.folded_root == leaf(one[0], None) and r.verified and r.proof_sha256 == sha("")


def test_manifest_files_hold_every_node(spark, tmp_path, monkeypatch):
    for name, value in (("ROWS", 5), ("LEAST_ROWS", 1), ("RISE", 1), ("MORE_RISE", 1)):
        monkeypatch.setattr(merkle, name, value)
    rows = documents(60)
    found = merkle.manifest(spark.createDataFrame(rows, DOC_COLUMNS))
    found.write(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m/documents/nodes")).collect()
    want, by = set(), defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1])))
    for s, own in by.items():
        for level, row in enumerate(layers([x[2] for x in sorted(own)])):
            want |= {(s, level, i, h) for i, h in enumerate(row) if level}
    assert {(r.grp, r.level, r.idx, r.hash.hex()) for r in stored} == want
    assert sum(1 for _ in stored) == len(want)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 100, 244])
def test_peaks_of_any_cut_merge_to_the_root(n):
    rng = random.Random(n)
    tree = layers([sha(str(i)) for i in range(n)])
    cut = sorted({0, n, *(rng.randint(0, n) for _ in range(5))})
    peaks = []
    for a, b in zip(cut, cut[1:], strict=False):
        made = list(merkle.climbed(n, ((0, i, bytes.fromhex(tree[0][i])) for i in range(a, b))))
        assert all(h.hex() == tree[level][i] for level, i, h, _ in made)
        peaks += [(level, i, h) for level, i, h, kind in made if kind != merkle.INNER]
    # a peak has no more than FANOUT - 1 others of its level beside it in a range's end
    assert len(peaks) <= len(cut) * 2 * 2 * len(tree)
    ends = [x for x in merkle.climbed(n, sorted(peaks, key=lambda p: p[1] * 3 ** p[0])) if x[3] == merkle.ROOT]
    assert [x[2].hex() for x in ends] == [tree[-1][0]]


VECTOR_COLUMNS = "vec_id long, embedding array<float>, label int, x int, was int, codes string, error long"


def vectors(n: int, d: int = 12, seed: int = 2) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, d))
    rows = [(i, (centre[i % 6] + rng.normal(scale=0.3, size=d)).astype(np.float32).tolist(), int(i % 3) if i % 7 else None) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * d, 1), (n + 2, [float("nan")] + [0.0] * (d - 1), 1), (n + 3, [float("inf")] * d, 1), (n + 4, [0.5] * (d - 1), 1), (n + 5, [], 1)]
    rows += [(5, rows[5][1], rows[5][2])] * 3 + [(7, [0.25] * d, None), (None, [0.125] * d, 2)] + [(n + 10 + i, [0.5] * d, 2) for i in range(n // 2)]
    return [(*r, 1, 2, "c", 3) for r in rows]


def lloyd(rows: list[tuple], entries: int, rounds: int, scale: int, parts: int = 4) -> tuple[list, str]:
    """Whole rounds with whole sums, number by number."""
    size = Counter(len(r[1]) for r in rows if r[1] and all(v is not None and np.isfinite(v) for v in r[1])).most_common(1)[0][0]
    kept = [(r[0], r[2], [int(np.floor(scale * float(v))) for v in r[1]]) for r in rows if r[1] and len(r[1]) == size and all(v is not None and np.isfinite(v) for v in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    at = [k * size // parts for k in range(parts + 1)]
    books = [[r[2][a:b] for r in kept[:entries]] for a, b in zip(at, at[1:], strict=False)]

    def nearest(x: list[int], book: list) -> tuple[int, int]:
        return min((sum((p - q) ** 2 for p, q in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for step in range(rounds + 1):
        found = [[nearest(r[2][a:b], books[p]) for p, (a, b) in enumerate(zip(at, at[1:], strict=False))] for r in kept]
        if step == rounds:
            break
        for p, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            own = defaultdict(list)
            for r, f in zip(kept, found, strict=True):
                own[f[p][1]].append(r[2][a:b])
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    error = Counter()
    for r, f in zip(kept, found, strict=True):
        error[r[1]] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), error[r[1]], digest) for r, f in zip(kept, found, strict=True)]


@pytest.mark.parametrize(("entries", "scale", "d"), [(16, 1024, 12), (256, 1024, 12), (8, 1 << 24, 14), (8, 1024, 2)])
def test_codes_against_whole_rounds(spark, entries, scale, d):
    """With few and many entries, components beyond exact doubles, uneven and empty parts."""
    rows = vectors(90, d)
    got = codes.compress(spark.createDataFrame(rows, VECTOR_COLUMNS).repartition(3), entries=entries, scale=scale)
    assert Counter(map(tuple, got.collect())) == Counter(lloyd(rows, entries, 4, scale))


def test_codes_move_only_what_changed(spark, monkeypatch):
    """Contributions of a round are those of parts with another entry than before."""
    seen = []
    real = codes.changes

    def counted(state, entries, pieces):
        moved = state.select(F.posexplode(F.zip_with(F.coalesce("was", F.transform("codes", lambda c: F.lit(-1))), "codes", lambda a, b: a != b)).alias("p", "moved")).where("moved").count()
        out = real(state, entries, pieces)
        seen.append((moved, out.where("count > 0 OR count < 0 OR size(sums) > 0").count(), out.agg(F.sum("count")).first()[0]))
        return out

    monkeypatch.setattr(codes, "changes", counted)
    rows = [r for r in vectors(90) if r[1] and len(r[1]) == 12 and None not in r[1] and np.isfinite(r[1]).all()]
    codes.compress(spark.createDataFrame(rows, VECTOR_COLUMNS), entries=16)
    assert seen[0][0] == 4 * len(rows) and seen[0][2] == 4 * len(rows)
    assert all(s[2] in (0, None) for s in seen[1:])  # what one entry gets another gives
    assert seen[3][0] < seen[0][0]


def test_codes_of_no_and_too_large_vectors(spark):
    assert codes.compress(spark.createDataFrame([], VECTOR_COLUMNS)).collect() == []
    assert codes.compress(spark.createDataFrame([(1, None, 1, 1, 1, "", 1)], VECTOR_COLUMNS)).collect() == []
    far = [(i, [(-1.0) ** i * 4e9] * 4, 1, 1, 1, "", 1) for i in range(4)]
    with pytest.raises(Exception, match="doesn't fit a long"):
        codes.compress(spark.createDataFrame(far, VECTOR_COLUMNS), entries=1).collect()


PROSE = "This line is prose, with a comma and an end. Another sentence follows it here, quite plainly so."


def texts() -> list[str | None]:
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(400)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)) + "."
    prose = "\n".join(sentence(15) for _ in range(8))
    menu, stock = "Home | About | Contact", "© 2020 Someone. All rights reserved."
    return [
        None, "", " \n\t\x0b ", "one", PROSE, prose, f"{prose}\n{menu}\n{stock}", "\n".join([*(f"Item {i} > Next > Top" for i in range(40)), sentence(20)]),
        " ".join(["same few words"] * 60) + ".", " ".join(f"LOUD{i}!!" for i in range(80)) + ".", " ".join(f"w{i}###" for i in range(80)) + " end.", f"{prose}\n{prose.splitlines()[0]}\n{prose.splitlines()[0]}",
        " ".join(f"u{i}" for i in range(120)), sentence(49), sentence(50), "\n".join(sentence(60) if i % 2 else " ".join(f"l{i}{j}" for j in range(60)) for i in range(4)), "漢字。 " * 3 + prose, "a\x1cb é ü $%& <x>", sentence(60) + "\r\n" + sentence(60), prose * 400,
    ]


def judged(text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    again = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    seen, dup, lost, left = set(), 0, 0, []
    for line in (text or "").split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own:
            dup += line in seen
            seen.add(line)
        bare = [w.rstrip("\"'”’»)]") for w in own]
        stops = any(w and w[-1] in ".!?…。！？؟।" for w in bare)
        noise = sum(len(w) > 1 and (w[-1] in "!?" and w[-2] in "!?" or w[-1] in "#*$%&|<>" and w[-2] in "#*$%&|<>") for w in bare)
        marks = sum(set(w) <= set("|<>»«·•/\\–—-") for w in own)
        menu = len(own) <= 8 and all(w.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") in lines.MENU for w in own)
        stock = len(own) <= 60 and any(p in line.lower() for p in lines.PHRASES)
        if own and (not stops or noise > 0.2 * len(own) or marks > max(1, 0.1 * len(own)) or menu or stock):
            lost += len(own)
        else:
            left.append(line)
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(again), failed, not failed and lost <= 0.5 * len(words), lost, "\n".join(left)


def test_lines_against_brute_force(spark):
    rows = [(i, t, "en", "s", 1, "g", 1, 2, b"h", "w", True, 3) for i, t in enumerate(texts())] + [(None, PROSE, None, None, None, "g", 1, 2, b"h", "w", True, 3)] * 2
    got = lines.clean(spark.createDataFrame(rows, DOC_COLUMNS).repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *judged(r[1])) for r in rows)
    assert lines.clean(spark.createDataFrame([], DOC_COLUMNS)).collect() == []


def test_lines_rules_and_verdicts():
    found = [lines.judged((t or "").encode()) for t in texts()]
    kept = [f[6] for f in found]
    assert kept[5] and kept[6] and kept[11] and kept[14] and kept[18] and kept[15]
    assert not any(kept[i] for i in (0, 1, 2, 3, 4, 7, 8, 9, 10, 12, 13))
    assert found[6][8] == found[5][8]  # the menu and the stock line go, the prose stays
    assert lines.fails("Home About Contact.", 3) == "navigation" and lines.fails("a | b | c.", 5) == "navigation"
    assert lines.fails("We use cookies.", 3) == "boilerplate" and lines.fails("No end", 2) == "punctuation" and lines.fails(PROSE, 17) is None
    long = " ".join(["word"] * 61) + " cookie."
    assert lines.fails(long, 62) is None  # a stock phrase within a long line
