import random
import zlib

import numpy as np
import pytest

from kinweave.llm import packing, wavelet
from kinweave.llm import tokens as tokens_module
from kinweave.llm.queries import vocabulary
from kinweave.llm.tokens import tokens

TRICKY = ["it's they're we'll I'd 'tis ''s don't\n'st", "", "   ", " a  b\n\n c \t\td", "<|endoftext|>x", "Σίσυφος İ é", "12345 a1b2", "x y", "'", "'re 're", "🙂🙂 ok 🙂's"]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_ids_are_the_librarys(name, kind):
    vocab = tokens(vocabulary(name), kind)
    rnd = random.Random(2)
    texts = TRICKY + ["".join(rnd.choice(" \n'streλvl1²é#😀Σß A") for _ in range(rnd.randrange(1, 30))) for _ in range(400)]
    ids, counts = vocab.encode(texts)
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [g.tolist() for g in got] == [vocab.library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_ids_over_all_planes(name, kind):
    """Code points of every plane, unassigned and lately assigned ones too, between letters, digits, blanks and quotes."""
    vocab = tokens(vocabulary(name), kind)
    points = [0x1C89, 0x1C8A, 0xA7CB, 0xA7DC, 0xFEFF, *(c for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000)]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)}'s\ufeff{chr(c)}" for c in points]
    ids, counts = vocab.encode(texts)
    got = np.split(ids, np.cumsum(counts)[:-1])
    want = vocab.library.encode_batch(texts, add_special_tokens=False)
    assert [g.tolist() for g in got] == [w.ids for w in want]


def test_ids_when_hashes_collide(monkeypatch):
    """Long pre-tokens under one hash, in one slice and across slices, are told apart by their bytes."""
    monkeypatch.setattr(tokens_module, "mix", lambda x: x * np.uint64(0))
    vocab = tokens_module.Tokens(vocabulary("byte_bpe_50k.json"), "bytes")
    for texts in (["alphabetical"], ["alphabetically ordered", "something", "abcdefg abcdefgh"], ["z" * 40, "z" * 41]):
        ids, _ = vocab.encode(texts)
        assert ids.tolist() == [i for t in texts for i in vocab.library.encode(t, add_special_tokens=False).ids]


def test_packing(odd, odd_rows, none):
    rows = packing.pack(odd, vocabulary("byte_bpe_50k.json"), capacity=256).toPandas()
    library = tokens(vocabulary("byte_bpe_50k.json"), "bytes").library
    want = []
    for doc, text, *_ in odd_rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        head = len(ids) % 256 or 256
        cuts = [0, *range(head, len(ids) + 1, 256)]
        want += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: tuple(-1 if v is None or v != v else int(v) for v in r)
    assert sorted(map(key, rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(key, want))
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 256) * 1.1 + 1
    assert packing.pack(none, vocabulary("byte_bpe_50k.json")).count() == 0


def test_ranges_swept_apart_match_as_one():
    """Sweeps of ranges, settled by rank, give every document the gap that one sweep over all gives it, the best fit."""
    rnd = random.Random(5)
    for _ in range(200):
        events = [(rnd.randrange(33, 65), packing.DOCUMENT, k, 0) for k in range(rnd.randrange(40))]
        gaps = [(rnd.randrange(33, 200), packing.GAP, 100 + k) for k in range(rnd.randrange(30))]
        events = sorted(events + [(f, g, n, max(1, f // 64)) for f, g, n in gaps], key=lambda e: (-e[0], -e[1], e[2]))
        columns = lambda rows: [list(c) for c in zip(*rows)] or [[], [], [], []]
        want, alone, _ = packing.sweep(*columns(events))
        free, slots = [], {n: m for _, k, n, m in events if k == packing.GAP}
        for size, kind, name, _ in events:  # one at a time: the least gap of those that hold it
            if kind == packing.GAP:
                free.append(name)
            elif free:
                assert (name, free[-1], size) in want
                slots[free[-1]] -= 1
                free = [f for f in free if slots[f]]
        cuts = sorted(rnd.sample(range(len(events) + 1), min(4, len(events))))
        got, left, lists = [], {}, {}
        for part, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(events)])):
            matches, unplaced, open_ = packing.sweep(*columns(events[lo:hi]))
            got += matches
            lists[part] = unplaced, [n for n, m in open_ for _ in range(m)]
            left[part] = len(unplaced), len(lists[part][1])
        for part, low, high, other, top in packing.settle(left):
            got += [(lists[part][0][r][0], lists[other][1][top - (r - low)], lists[part][0][r][1]) for r in range(low, high)]
        assert sorted(got) == sorted(want) and len(want) + len(alone) == sum(k == packing.DOCUMENT for _, k, _, _ in events)


def test_wavelet_round_trip(plain, odd, none, odd_rows):
    rows, df = plain
    library = tokens(vocabulary("word_bpe_49k.json"), "words").library
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in wavelet.round_trip(df, vocabulary("word_bpe_49k.json")).collect()}
    start, want = 0, {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want[doc] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want
    assert wavelet.round_trip(odd, vocabulary("word_bpe_49k.json")).count() == len(odd_rows)
    assert wavelet.round_trip(none, vocabulary("word_bpe_49k.json")).count() == 0


def test_wavelet_file(tmp_path):
    ids = np.random.default_rng(3).integers(0, 40, 2500).astype(np.uint16)
    uri = f"file://{tmp_path}/s.kww"
    wavelet.write_file(uri, [7, None], np.array([2000, 500]), ids, 16)
    file = wavelet.WaveletFile(uri)
    assert [file.access(k) for k in range(0, 2500, 61)] == ids[::61].tolist()
    for token in (0, 13, 39, 41, 70000):
        where = np.flatnonzero(ids == token).tolist()
        assert file.occurrences(token) == where and file.count(token, 100, 1700) == sum(100 <= w < 1700 for w in where)
    assert [d for d, _ in file.documents()] == [7, None] and file.decode().tolist() == ids.tolist()
    with pytest.raises(IndexError):
        file.access(2500)
