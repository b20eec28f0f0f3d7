"""Helpers without Spark, against plain versions."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest

from pulsegrid.llm import common, exact, fingerprints, langid, lines, nearcopies, packing, pieces, substring, toxicity


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_perfect_hash_is_minimal_and_checked():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    sizes, maps, slots = exact.build_levels(b"".join(keys[:2000]))
    assert sorted(slots) == list(range(2000))
    assert (exact.find_slots(sizes, maps, b"".join(keys[:2000])) == slots).all()
    assert exact.build_levels(b"")[2].tolist() == []


def test_pieces_equal_the_library():
    table = pieces.ChunkTable(public_tokenizers.path("piece_bpe_32k.model"))
    rng, parts = random.Random(1), [" ", "  ", pieces.MARK, "a", "The", "\n", "\t", "é", "漢", "😀", "ﬁ", "\x00", "\xa0", "</s>", "<0x41>", "x" * 90]
    texts = ["", " ", "a " * 5000, *("".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(1500))]
    ids, sizes, said = table.run(texts)
    for t, got, text in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), said, strict=True):
        want = [*table.model.encode(t), 2]
        assert got.tolist() == want and text == table.model.decode(want)


def test_word_ids_equal_the_library():
    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng, parts = random.Random(2), [" ", "'s", "'", "Th", "\n", "é", "漢", "Å", "ﬁ", "\x00", "Σ", "İ", "12", "!?", "\x1c", "<|endoftext|>", "́", "word"]
    texts = ["", *("".join(rng.choice(parts) for _ in range(rng.randrange(10))) for _ in range(1500))]
    for t, got in zip(texts, enc.run(texts), strict=True):
        assert got.tolist() == enc.library.encode(t, add_special_tokens=False).ids


def test_nnls_and_plan():
    rng = np.random.default_rng(3)
    a, want = rng.random((12, 8)), np.abs(rng.normal(size=8)) * (rng.random(8) > 0.4)
    assert np.allclose(packing.nnls(a, a @ want), want, atol=1e-6)
    histogram = {1: 90, 3: 40, 5: 30, 8: 7}
    used = dict.fromkeys(histogram, 0)
    for way, times in packing.plan(histogram, 8):
        assert sum(way) == 8
        for n in way:
            used[n] += times
    assert all(used[n] <= histogram[n] for n in histogram) and used[8] == 7 and sum(used.values()) > 60


def test_best_fit_leaves_no_gaps():
    rng = random.Random(4)
    lengths = [rng.randrange(1, 100) for _ in range(400)]
    where, offsets = packing.best_fit(lengths, 100)
    for s in set(where):
        inside = sorted((o, n) for w, o, n in zip(where, offsets, lengths, strict=True) if w == s)
        assert all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:])) and inside[0][0] == 0 and sum(inside[-1]) <= 100
    assert len(set(where)) < sum(lengths) / 100 * 1.05 + 1


def test_gear_hash_and_chunks():
    raw = words(random.Random(5), 3000).encode()
    h = substring.gear_hashes(np.frombuffer(raw, np.uint8))
    for i in (0, 5, 15, 16, 999):
        assert int(h[i]) == sum(int(substring.GEAR[raw[i - k]]) << k for k in range(min(16, i + 1))) % 65536
    ends = substring.ends_of(raw)
    assert ends[-1] == len(raw) and all(16 <= b - a <= 256 for a, b in zip([0, *ends[:-2]], ends[:-1]))
    chunks = lambda r: {r[a:b] for a, b in zip([0, *substring.ends_of(r)[:-1]], substring.ends_of(r))}
    moved = raw[:1000] + b"inserted words " + raw[1000:]
    assert len(chunks(raw) - chunks(moved)) < 6
    for e in substring.ends_of(("é漢😀" * 400).encode()):
        ("é漢😀" * 400).encode()[:e].decode()


def test_language_model_sums_all_segmentations():
    v = langid.Vocabulary(["▁a", "b", "ab", "▁ab", "▁", "a"])
    p = np.full((v.size + 1, 1), 0.1)
    p[-1] = 0
    got = langid.forward(v.spans(["▁ab"]), p, 1)[-1][0, 0]
    # ▁ab; ▁a b; ▁ ab; ▁ a b
    assert got == pytest.approx(0.1 + 0.01 + 0.01 + 0.001)


def test_language_model_learns():
    rng = random.Random(6)
    made = {"xx": [words(rng, 30).replace("w", "ka").replace("1", "o") for _ in range(30)], "yy": ["".join(rng.choice("zvrt ") for _ in range(200)) for _ in range(30)]}
    counts = {k: {} for k in made}
    for k, texts in made.items():
        for t in texts[:20]:
            for w in langid.words_of(t):
                counts[k][w] = counts[k].get(w, 0) + 1
    model = langid.fit(counts, list("▁abcdefghijklmnopqrstuvwxyz"), {"xx": 20, "yy": 20})
    names, scores = model.predict([*made["xx"][20:], *made["yy"][20:], "", "12 !"])
    assert names == ["xx"] * 10 + ["yy"] * 10 + ["und"] * 2 and all(0 <= s <= 1 for s in scores)


def test_toxicity_generalises_to_misspellings():
    rng = random.Random(7)
    clean, bad = [words(rng, 60) for _ in range(200)], []
    for _ in range(80):
        t = words(rng, 60).split()
        t[rng.randrange(60)] = rng.choice(["horribleword", "nastything"])
        bad.append(" ".join(t))
    model = toxicity.fit(clean[:150] + bad[:60], np.array([False] * 150 + [True] * 60))
    assert (model.score(bad[60:]) >= 0.7).mean() > 0.9 and (model.score(clean[150:]) >= 0.7).mean() < 0.05
    assert model.score([words(rng, 40) + " horriblewordx"])[0] > model.score([words(rng, 40)])[0]
    assert 0 <= model.score([""])[0] <= 1
    one = toxicity.fit(["a"], np.array([False]))
    assert one.score(["a", ""])[0] < 0.7


def test_probability_jaccard():
    def plain(a, b):
        return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a | b) for d in a if d in b)

    rng = random.Random(8)
    for _ in range(200):
        a, b = ({rng.randrange(12): rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))} for _ in range(2))
        arrays = lambda x: (np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)], np.int32))
        got = nearcopies.similarity(*arrays(a), *arrays(b))
        assert got == pytest.approx(plain(a, b))
        assert nearcopies.bounds([arrays(a)], [arrays(b)])[0, 0] >= got - 1e-5


def test_registers_estimate_probability_jaccard():
    rng = random.Random(9)
    base = [f"w{rng.randrange(50)}" for _ in range(300)]
    other = base[:240] + [f"v{rng.randrange(50)}" for _ in range(60)]
    h, w, n = nearcopies.shingles([base, other])
    held = nearcopies.registers(h, w, n, m=2000)
    got = (held[0] == held[1]).mean()
    assert abs(got - nearcopies.similarity(h[: n[0]], w[: n[0]], h[n[0] :], w[n[0] :])) < 0.05
    assert nearcopies.shingles([[], ["a"]])[2].tolist() == [0, 1]
    one = nearcopies.registers(*nearcopies.shingles([["a"]]), m=8)
    assert len(set(one[0].tolist())) == 1 and one[0, 0] != 0


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(10)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(12))) for _ in range(2))
        assert lines.edit_distance(a, b) == plain(a, b)
    assert lines.edit_similarity("", "") == 1 and lines.normalised("  Page 12, of_9! ") == "page 12 of 9"


def test_simhash_of_near_lines_is_near():
    a = "the quick brown fox jumps over the lazy dog near the river bank today"
    h = lines.simhashes([a, a.replace("lazy", "lazi"), "entirely different words are found in this other line here", "x"])
    bits = lambda i, j: bin(int(h[i]) ^ int(h[j])).count("1")
    assert bits(0, 1) < 12 < bits(0, 2)


def test_digests():
    text = words(random.Random(11), 300).encode()
    other = words(random.Random(12), 300, 50).upper().encode()
    a, b, c = (fingerprints.digest(t) for t in (text, text[:-20] + b"something else here!", other))
    assert len(a) == 66 and fingerprints.digest(text) == a
    near, far, same = fingerprints.likeness([a, a, a], [b, c, a])
    assert same == 1 and 0 <= far < near < 1
    assert fingerprints.likeness([], []).tolist() == [] and len(fingerprints.digest(b"")) == len(fingerprints.digest(b"ab")) == 66


def test_long_words_are_summed_whole():
    """The scaled sums equal those over all segmentations, also where plain ones would vanish, and no word is cut."""
    rng = random.Random(16)
    pieces_ = ["▁", *"abcde", "▁ab", "abc", "dedede", "abcdeabcdeabcde", "ee"]
    counts = {k: {"▁" + "".join(rng.choice(s) for _ in range(7)): 3 for _ in range(50)} for k, s in (("xx", "aabce"), ("yy", "bddee"))}
    model = langid.fit(counts, pieces_, {"xx": 1, "yy": 1})
    for n in (1, 7, 15, 40, 90, 1500):
        w = "▁" + "".join(rng.choice("abcdeé") for _ in range(n))
        for k in range(2):
            p = dict(zip(model.vocabulary.hashes.tolist(), model.probabilities[:, k]))
            log, scale = [1.0], 0.0
            for j in range(1, len(w) + 1):
                total = 0.0
                for i in range(max(0, j - 16), j):
                    q = p.get(int(langid.Vocabulary.keys([w[i:j]])[0]), langid.FLOOR if j - i == 1 else 0.0)
                    total += log[i] * q
                log.append(total)
                if total < 1e-100:
                    log, scale = [*[0.0] * (len(log) - 17), *(x * 1e100 for x in log[-17:])], scale - 100 * np.log(10)
            assert model.word_scores([w])[0, k] == pytest.approx(np.log(log[-1]) + scale)
        assert langid.words_of(w[1:]) == [w]


def test_every_language_can_be_predicted():
    names = [f"l{i}" for i in range(230)]
    counts = {n: {f"▁{chr(0x4E00 + 3 * i)}{chr(0x4E01 + 3 * i)}": 5} for i, n in enumerate(names)}
    model = langid.fit(counts, ["▁"], dict.fromkeys(names, 1))
    assert len(model.languages) == 230


def test_unassigned_code_points_get_the_library_ids():
    """Every code point that this Python's Unicode tables lack, and every 37th other, inside a word."""
    import sys
    import unicodedata

    import public_tokenizers

    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    some = [c for c in map(chr, range(1, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and (ord(c) % 37 == 0 or unicodedata.category(c) == "Cn")]
    some = [c for i, c in enumerate(some) if i % 4 == 0 or ord(c) < 0x3000 or "\U00010D40" <= c < "\U00010D90" or "\U000187F0" <= c < "\U00018D90"]
    texts = [f"a{c}b x{c}" for c in some] + [f"a{chr(sys.maxunicode)}b"]
    want = encoder.library.encode_batch(texts, add_special_tokens=False)
    assert [g.tolist() for g in encoder.run(texts)] == [w.ids for w in want]


def test_one_operators_things_are_kept_at_a_time():
    common.held("a", dict)["x"] = 1
    assert common.held("a", dict) == {"x": 1}
    common.held("b", dict)
    assert common.held("a", dict) == {}


def test_many_pairs_at_once_equal_single_ones():
    rng = random.Random(18)
    said = ["", "x"]
    for n in (1, 5, 30, 63, 64, 65, 130, 300):
        for share in (0.02, 0.1, 0.19, 0.22, 0.4):
            for _ in range(8):
                t = "".join(rng.choice("abcdeéf ") for _ in range(n))
                u = [rng.choice([rng.choice("abcdeé漢"), "", c + "z"]) if rng.random() < share else c for c in t]
                said += [t, "".join(u)]
    u, v = np.arange(0, len(said), 2), np.arange(1, len(said), 2)
    want = [lines.edit_similarity(said[i], said[j]) >= lines.THRESHOLD - 1e-9 for i, j in zip(u, v)]
    for few in (0, 96):
        lines.FEW = few
        assert lines.alike(said, u, v).tolist() == want
    assert (lines.in_reach(said, u, v) >= np.array(want)).all()


def test_linked_lines_are_not_verified_again(monkeypatch):
    """Groups of near copies are connected by few verified pairs; the groups are those of all pairs."""
    rng, said, seen = random.Random(7), [], []
    for _ in range(3):
        t = [rng.choice("abcdefghij ") for _ in range(120)]
        said += ["".join(rng.choice("xyz") if rng.random() < 0.05 else c for c in t) for _ in range(40)]
    real = lines.alike
    monkeypatch.setattr(lines, "alike", lambda ls, u, v: seen.extend(u.tolist()) or real(ls, u, v))
    u, v = np.triu_indices(40, 1)
    u, v = (np.concatenate([x + 40 * k for k in range(3)]) for x in (u, v))
    out = lines.links(said, u, v)
    assert len(out) == 3 * 39 and all(x // 40 == y // 40 for x, y in out)
    assert len(seen) < len(u) / 4


def test_buckets_keep_only_members_in_reach():
    """Members that no chain of pairs in reach connects part; no pair in reach is lost, at any number of members."""
    rng = np.random.default_rng(4)
    for n in (2, 3, 40, 600):
        lengths, keys = rng.integers(130, 400, n), np.zeros(n, np.int64)
        ats, sizes = (rng.random(n) * lengths).astype(np.int64), (np.log(lengths) * lines._STEP).astype(np.int64)
        order = np.lexsort((np.arange(n), sizes))
        ids, lengths, ats, sizes = np.arange(n)[order], lengths[order], ats[order], sizes[order]
        key, out, _, many, place, boss = lines.reachable(keys, ids, sizes, ats)
        group = dict(zip(out.tolist(), key.tolist()))
        assert len(group) == len(out) and set(np.bincount(np.unique(key, return_inverse=True)[1])) <= set(many.tolist())
        for i in range(n):
            for j in range(i):
                if abs(lengths[i] - lengths[j]) <= (most := lines.edits_most(max(lengths[i], lengths[j]))) and abs(ats[i] - ats[j]) <= most:
                    assert group[int(ids[i])] == group[int(ids[j])]
    apart = lines.reachable(np.zeros(4, np.int64), np.arange(4), np.full(4, 110), np.array([0, 10, 180, 190]))
    assert apart[3].tolist() == [2] * 4 and apart[5].tolist() == [0, 0, 2, 2] and len(set(apart[0].tolist())) == 2
    assert not len(lines.reachable(np.zeros(2, np.int64), np.arange(2), np.full(2, 110), np.array([0, 200]))[0])


def recall(rng, said, shares):
    """The share of edited pairs of lines that get to verification, among those that are alike."""
    hit = n = 0
    for t in said:
        for share in shares:
            u = list(t)
            for k in rng.sample(range(len(t)), max(1, int(share * len(t)))):
                u[k] = rng.choice([rng.choice("abcdefghijklmnopqrstuvwxyz"), "", u[k] + rng.choice("abcdefghij ")])
            pair = [lines.normalised(t), lines.normalised("".join(u))]
            if pair[0] == pair[1] or lines.edit_similarity(*pair) < lines.THRESHOLD:
                continue
            of, keys, places = lines.gram_keys(pair)
            left, right = ({k: p for o, k, p in zip(of.tolist(), keys.tolist(), places.tolist()) if o == side} for side in (0, 1))
            both = [k for k in left if k in right]
            zeros, one = np.zeros(len(both), np.int64), np.ones(len(both), np.int64)
            n += 1
            hit += bool(both) and len(lines.likely_pairs(pair, zeros, one, np.array([left[k] for k in both]), np.array([right[k] for k in both]))) > 0
    return hit / n


def test_line_search_recall():
    """Real lines cut to several lengths, 1 to 15 characters in 100 changed: the search meets at least nine in ten pairs."""
    import pyarrow.parquet as pq

    rng = random.Random(19)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    real = sorted({n for t in texts if t for n in lines.normalised_lines(t)}, key=len)
    shares = [k / 100 for k in range(1, 16, 2)]
    for least, most in ((20, 32), (32, 64), (64, 128), (128, 256), (256, 400)):
        some = [t[: rng.randrange(least, most)].strip() for t in rng.sample([t for t in real if len(t) >= least], 30)]
        assert recall(rng, [t for t in some if len(t) >= 8], shares) >= 0.9
    assert recall(rng, [t[:300] for t in real if len(t) > 300][:40], [0.01, 0.05, 0.1]) >= 0.95


def test_a_common_passage_alone_makes_no_pair():
    """Of lines that share a passage only those get to verification that are alike elsewhere, too; edits that lie together and
    lines that are compared as a whole are no reason to leave a pair out."""
    rng = random.Random(23)
    said = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = said(60)
    some = [f"{said(150)}x{passage}y{said(150)}" for _ in range(30)]
    at = np.full(1, 170)
    pairs = [(i, j) for j in range(30) for i in range(j)]
    x, y = (np.array(k) for k in zip(*pairs))
    assert len(lines.likely_pairs(some, x, y, np.repeat(at, len(x)), np.repeat(at, len(x)))) < len(pairs) / 20
    t = some[0]
    near = [t[:100] + said(50) + t[150:], t[:220] + said(60) + t[220:], t[:150] + t[200:], said(40) + t[40:320] + said(30)]
    for u in near:
        assert lines.edit_similarity(t, u) >= lines.THRESHOLD
        place = u.index(t[205:217])
        assert lines.likely_pairs([t, u], *(np.array([k]) for k in (0, 1, 205, place))).tolist() == [1]
    short = f"{passage}{said(14)}"
    u = short[:60] + said(14)
    assert lines.edit_similarity(short, u) >= lines.THRESHOLD and len(lines.likely_pairs([short, u], *(np.array([k]) for k in (0, 1, 5, 5)))) == 1


def test_letters_that_two_lines_share_at_a_place():
    rng = random.Random(24)
    code = np.array([0] * 8 + [rng.randrange(3) for _ in range(3000)] + [0] * 8, np.uint8)
    code[1000:1100] = code[2000:2100]
    x, y = (np.array([rng.randrange(108, 2900) for _ in range(500)] + [k]) for k in (1040, 2040))
    room = np.array([rng.choice([0, 1, 7, 8, 9, 100]) for _ in range(500)] + [100])
    for step in (1, -1):
        got = lines._matched(code, x, y, room, step)
        for a, b, n, m in zip(x, y, room, got):
            want = 0
            while want < n and code[a + step * want - (step < 0)] == code[b + step * want - (step < 0)]:
                want += 1
            assert m == want


def test_a_plan_over_all_lengths_takes_little_memory():
    histogram = {n: 50 + 37 * n % 101 for n in range(1, 257)}
    tracemalloc.start()
    try:
        chosen = packing.plan(histogram, 256)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64e6 and all(sum(way) == 256 for way, _ in chosen)
    assert sum(times * len(way) for way, times in chosen) > 0.9 * sum(histogram.values())
