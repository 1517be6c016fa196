"""Benchmark passages against the full edit-distance table, and the recall on edited ones."""
import random

import numpy as np
import pytest

from shelfledger.llm import decontam


def brute_distance(pattern, text):
    """Least distance of the pattern to a stretch of the text and its first end."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row), row.index(min(row))


def prose(r, n):
    return " ".join(r.choice(["the", "of", "and"]) if r.random() < 0.2 else "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def edited(r, text, k):
    chars = list(text)
    for _ in range(k):
        at = r.randrange(len(chars))
        kind = r.randrange(3)
        if kind == 0:
            chars[at] = r.choice("abcde ")
        elif kind == 1:
            chars.insert(at, r.choice("abcde "))
        else:
            del chars[at]
    return "".join(chars)


def test_distance_is_that_of_the_table():
    r = random.Random(1)
    for _ in range(1500):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 14)))
        assert decontam.distance(p, t) == brute_distance(p, t)
        d, a, b = decontam.match(p, t)
        assert d == brute_distance(p, t)[0] and brute_distance(p, t[a:b])[0] == d


@pytest.mark.parametrize("size", [1, 3, 8, 12])
def test_gram_hashes_tell_grams_apart(size):
    code = np.random.default_rng(size).integers(1, 4, 300).astype(np.uint8)
    h = decontam.grams(code, size)
    grams = [bytes(code[i:i + size]) for i in range(300 - size + 1)]
    assert len(h) == len(grams) and len(set(zip(h.tolist(), grams))) == len(set(grams)) == len(set(h.tolist()))


@pytest.fixture(scope="module")
def items():
    r = random.Random(2)
    return [(k, prose(r, r.randint(18, 70))) for k in range(60)]


def test_every_verbatim_item_is_found_anywhere(items):
    r = random.Random(3)
    texts, want = [], []
    for i, t in items:
        for before, after in ((0, 0), (0, 30), (30, 0), (200, 400)):
            shown = "".join(c.upper() if r.random() < 0.2 else c for c in t).replace(" ", "\n", 2)
            texts.append(f"{prose(r, before)} {shown} {prose(r, after)}" if before + after else shown)
            want.append(i)
    for i, found, text in zip(want, decontam.Detector(items).find(texts), texts):
        hit = next(m for m in found if m[0] == i)
        assert hit[3] == 0 and decontam.folded(text)[hit[1]:hit[2]] == decontam.folded(dict(items)[i])


def spread(r, text, k):
    """The text with k edits at even distances."""
    chars = list(text)
    for at in [int((j + 0.5) * len(chars) / k) for j in range(k)][::-1]:
        chars[at:at + 1] = r.choice([["q"], [chars[at], "q"], []])
    return "".join(chars)


@pytest.mark.parametrize("size", [14, 20, 40, 80, 200, 500])
def test_recall_on_edited_items(size):
    """Edits up to the operator's own bound, at random places and at even distances."""
    r = random.Random(size)
    items = [(k, prose(r, size)[:size]) for k in range(25)]
    detector = decontam.Detector(items)
    for share in (0.03, 0.06, 0.09, 0.1):
        k = int(share * size)
        for way in (edited, spread) if k else ():
            texts = [f"{prose(r, r.randint(0, 40))} {way(r, t, k)} {prose(r, 20)}" for _, t in items]
            found = detector.find(texts)
            assert np.mean([i in {m[0] for m in f} for (i, _), f in zip(items, found)]) >= 0.95, (share, way)


def test_equal_to_all_distances():
    """On a small table all pairs of items and texts, verbatim, edited and clean."""
    r = random.Random(12)
    items = [(k, prose(r, 60)[:r.choice([8, 11, 14, 25, 45, 70])]) for k in range(14)]
    texts = [prose(r, 30) for _ in range(6)] + [f"{prose(r, 8)} {edited(r, t, int(len(t) * r.random() * 0.25))} {prose(r, 8)}" for _, t in items] + [t for _, t in items] + ["", "the"]
    for text, found in zip(texts, decontam.Detector(items).find(texts)):
        held = {i: d for i, t in items if (d := brute_distance(decontam.folded(t), decontam.folded(text))[0]) <= int(decontam.EDITS * len(t))}
        assert {i: d for i, _, _, d in found} == held


@pytest.mark.parametrize("size", range(8, 400, 7))
def test_edits_leave_enough_tiles(size):
    tile, n, least = decontam.tiling(size)
    k = int(decontam.EDITS * size)
    assert 1 <= tile <= decontam.TILE and n * tile <= size and least == n - k >= 1


def test_what_is_found_is_within_the_distance_and_clean_texts_stay_clean(items):
    r, items = random.Random(5), items[:8]
    texts = [prose(r, 60) for _ in range(8)] + [f"{prose(r, 10)} {edited(r, t, int(len(t) * r.random() * 0.4))} {prose(r, 10)}" for _, t in items]
    for text, found in zip(texts, decontam.Detector(items).find(texts)):
        held = {i: d for i, t in items if (d := brute_distance(decontam.folded(t), decontam.folded(text))[0]) <= decontam.EDITS * len(t)}
        assert {i: d for i, _, _, d in found}.items() <= held.items()
    assert not any(decontam.Detector(items).find(texts[:8]))


def test_rows_nulls_blocks_and_other_columns(spark, items, monkeypatch):
    r = random.Random(6)
    t = items[7][1]
    rows = [(1, f"é中 {t.upper()} x"), (1, f"é中 {t.upper()} x"), (2, None), (3, ""), (4, prose(r, 100)), (None, t), (5, prose(r, 30000) + t + prose(r, 9))]
    df = spark.createDataFrame([(*x, "y", 1) for x in rows], "doc_id long, text string, item_id string, start int")
    bench = spark.createDataFrame([*items, (900, t), (901, None), (902, ""), (903, "short"), (7, t)], "item_id long, text string")
    want = sorted((d, i, 0) for d in (1, 1, -1, 5) for i in (7, 900))
    for limit in (1 << 24, 2000):
        monkeypatch.setattr(decontam, "blocks", lambda b, split=decontam.blocks, limit=limit: split(b, limit))
        got = decontam.matches(df, bench).collect()
        assert sorted((-1 if m.doc_id is None else m.doc_id, m.item_id, m.distance) for m in got) == want
        kept = decontam.drop_contaminated(df, bench)
        assert kept.columns == df.columns and sorted((x.doc_id, x.text) for x in kept.collect()) == [(2, None), (3, ""), (4, rows[4][1])]
        monkeypatch.undo()
    assert decontam.matches(df, bench.limit(0)).collect() == [] and decontam.matches(df.limit(0), bench).collect() == []
    assert decontam.drop_contaminated(df, bench.limit(0)).count() == len(rows)


def test_verbatim_items_in_any_script_and_case():
    plain = "съешь же ещё этих мягких французских булок да выпей чаю"
    greek = "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί"
    detector = decontam.Detector([(1, plain), (2, greek.upper()), (3, "the quick brown fox jumps over the lazy dog")])
    texts = [plain.upper(), f"до того {plain.title()} и после", greek, f"x {greek.title()} y", "the quick brown fox jumps　over the lazy dog", plain.replace(" ", " ")]
    found = [[(m[0], m[3]) for m in x] for x in detector.find(texts)]
    assert found == [[(1, 0)], [(1, 0)], [(2, 0)], [(2, 0)], [(3, 0)], [(1, 0)]]


def test_folded_is_lower_case_with_blanks():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x30000)]))
    assert decontam.folded(every) == "".join(" " if c.isspace() else c.lower() if len(c.lower()) == 1 else c for c in every)
