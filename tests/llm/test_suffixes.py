"""Shard transforms and their merge, against sorted lists and counts of strings."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import flat, suffixes

LENGTH = 24


def _laid_out(segments):
    sizes = np.array([len(x) for x in segments])
    place = np.concatenate([np.arange(n + 1) for n in sizes])
    room = np.repeat(sizes, sizes + 1) - place
    code = suffixes.codes(np.concatenate([np.append(x, np.uint8(0)) for x in segments]), room)
    return code, place, room, np.append(0, np.cumsum(sizes + 1))


def _symbols(code, room, row, most=99):
    return tuple(int(code[row + 8 * i]) for i in range(min(most, room[row] // 8)))


@pytest.fixture(params=range(20))
def segments(request):
    rng = np.random.default_rng(request.param)
    pool = [rng.integers(0, 2, 60).astype(np.uint8) for _ in range(2)]
    out = []
    for _ in range(rng.integers(1, 12)):
        x = pool[rng.integers(2)].copy()
        x[rng.integers(60)] ^= rng.integers(0, 2, dtype=np.uint8)
        a = rng.integers(0, 30)
        out.append(x[a : a + rng.integers(LENGTH, 31)])
    return list({x.tobytes(): x for x in out}.values())


def test_a_shard_is_in_order_and_its_transform_leads_from_row_to_row(segments):
    code, place, room, _ = _laid_out(segments)
    suffix, symbol, to = suffixes.transforms(code, room, np.array([0, len(code)]), LENGTH)
    assert sorted(suffix.tolist()) == list(range(len(code)))
    listed = [_symbols(code, room, s, 4) for s in suffix]
    assert listed == sorted(listed)
    inner = place[suffix] >= 8
    assert (suffix[to[inner]] == suffix[inner] - 8).all()
    assert (symbol[inner] == code[suffix[inner] - 8]).all()


def test_merged_transforms_are_the_sorted_suffixes_of_all_shards(segments):
    code, place, room, cuts = _laid_out(segments)
    suffix, symbol, to = suffixes.transforms(code, room, cuts, LENGTH)
    # as if each row stood for several, so that none goes
    rows, block = suffixes.merge(symbol, to, np.flatnonzero(place[suffix] >= LENGTH), np.ones(len(code), bool), LENGTH)
    merged = suffix[rows[np.argsort(block, kind="stable")]]
    listed = [_symbols(code, room, s, LENGTH // 8) for s in merged]
    assert listed == sorted(_symbols(code, room, s, LENGTH // 8) for s in np.flatnonzero(room >= LENGTH))
    assert np.bincount(block.astype(int))[1:].tolist() == [n for _, n in sorted(Counter(listed).items())]


@pytest.mark.parametrize("shard", [1, 70, 10_000])
def test_repeated_places_are_those_of_strings_counted_twice(segments, shard):
    times = np.random.default_rng(len(segments)).integers(1, 3, len(segments))
    count, at, base = Counter(), [], 0
    for x, t in zip(segments, times, strict=True):
        for i in range(len(x) - LENGTH + 1):
            count[x[i : i + LENGTH].tobytes()] += t
            at.append((base + i, x[i : i + LENGTH].tobytes()))
        base += len(x)
    got = suffixes.repeated(np.concatenate(segments), np.array([len(x) for x in segments]), times, LENGTH, shard)
    assert got.tolist() == [p for p, w in at if count[w] > 1]


def test_segments_are_those_of_a_plain_scan():
    rng = np.random.default_rng(4)
    for length in (24, 64, 200):
        size = suffixes.anchor_size(length)
        assert suffixes.ANCHOR <= size < length
        for _ in range(8):
            texts = ["".join(rng.choice(list("ab"), rng.integers(0, 3 * length))) for _ in range(rng.integers(0, 6))]
            buf, off = flat.flat(pa.array(texts, pa.string()))
            for by_place in (False, True):
                want, before = [], None
                for text, (a, b) in enumerate(zip(off, off[1:], strict=False)):
                    for at in range(a, b - length + 1):
                        starts = np.arange(at, at + length - size + 1)
                        grams = flat.Hasher(buf)(starts, starts + size)
                        best = int(np.argmin(grams >> np.uint64(32)))
                        now = (text, starts[best] if by_place else grams[best])
                        if now != before:
                            want.append([int(grams[best]), text, at, 0])
                        want[-1][3] += 1
                        before = now
                assert np.stack([x.astype(object) for x in suffixes.segments(buf, off, length, by_place)], 1).tolist() == want if want else not len(suffixes.segments(buf, off, length, by_place)[0])


def test_anchors_that_recur_by_chance_are_too_short_for_a_window():
    words = [f"word{i:02}" for i in range(40)]
    texts = [" ".join(random.Random(i).choices(words, k=400)) for i in range(60)]  # two words meet again all the time, five don't
    buf, off = flat.flat(pa.array(texts))
    anchors, *_ = suffixes.segments(buf, off)
    assert len(np.unique(anchors)) > 0.9 * len(anchors)
