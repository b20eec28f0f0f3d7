"""The operators on small awkward tables: nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import chat, common, exact, fingerprints, langid, lines, nearcopies, packing, pieces, queries, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_at long, removed string, tie string"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = [sentence(rng, 120) for _ in range(6)]
    passage = sentence(rng, 70)
    long = sentence(rng, 9000)
    texts = [None, "", "   ", "!!!", "one two", "One Two", *base, base[0], base[0].upper(), long, base[1] + " " + passage + " tail", passage + " " + base[2]]
    near = base[3].split()
    near[50] = "changed"
    texts += [" ".join(near), base[4] + " extra", "ÄÖ漢字😀 " * 50]
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, out[8], (None, "null id"), (None, base[5])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None, None, 7, "x", "y") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").encode().lower()


def test_exact(docs, rows, none):
    for old in (None, exact.older_half(docs)):
        got = exact.exact_dedup(docs, in_history=old).collect()
        groups = defaultdict(list)
        for i, t in rows:
            groups[lower(t)].append(i)
        assert len(got) == len(rows)
        by = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
        for r in got:
            ids = by[r["text_sha256"]]
            known = [i for i in ids if i is not None]
            assert r["group_size"] == len(ids) and r["keep_id"] == (max(known) if known else None)
        assert sum(r["kept"] for r in got) == len(groups)
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact.exact_dedup(none).count() == 0
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact.drop_copies(none).count() == 0


def test_pieces(docs, rows, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.digests(pieces.encode_decode(docs, PIECES)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = [*model.encode(t or ""), 2]
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids))))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert pieces.encode_decode(none, PIECES).count() == 0


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    got = packing.pack_documents(docs, WORDS).collect()
    sequences, covered = defaultdict(list), defaultdict(int)
    for r in got:
        raw = [np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes() for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert r["ids_crc32"] in map(zlib.crc32, raw)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"]] += r["length"]
    assert covered == {i: sum(map(len, x)) for i, x in ids.items()}
    for inside in sequences.values():
        inside.sort()
        assert inside[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:])) and sum(inside[-1]) <= 2048
    assert packing.pack_documents(none, WORDS).count() == 0


def test_packing_is_tight(spark, small):
    got = queries.op5_packing(spark, small).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n"), F.count("*")).first()
    assert got[0] / (got[1] * 2048) > 0.98


def test_fingerprints(docs, rows, none):
    got = fingerprints.neighbours(docs).collect()
    unique = [(i, t) for k, (i, t) in enumerate(rows) if i is not None and rows.index((i, t)) == k]
    order = sorted(unique, reverse=True)
    assert len(got) == len(rows) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    for k, (i, t) in enumerate(order[:-1]):
        if i in (8, 9):
            continue  # a repeated id has itself as its neighbour
        t, after = t or "", order[k + 1][1] or ""
        half = len(t) // 2
        want = t[: len(t) - half] + after[:half]
        r = next(r for r in got if r["doc_id"] == i)
        assert r["edited"] == want and r["n_chars"] == len(t) and r["fingerprint"] == fingerprints.digest(t.encode()) and r["edited_fingerprint"] == fingerprints.digest(want.encode())
    assert fingerprints.neighbours(none).count() == 0


def test_fingerprint_neighbours_over_blocks(spark, small, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", 7)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), reverse=True)
    got = {r["doc_id"]: r["edited"] for r in fingerprints.neighbours(docs).collect()}
    for (i, t), (_, after) in zip(texts, [*texts[1:], texts[0]]):
        half = len(t) // 2
        assert got[i] == t[: len(t) - half] + after[:half]


def test_chat(spark):
    turns, rng = [], random.Random(3)
    for c in range(6):
        if c % 2:
            turns.append((c, 0, "system", "Be <brief> \\l"))
        turns += [(c, k, "assistant" if k % 2 == 0 else "user", sentence(rng, rng.randrange(1, 200)) + "</turn>\\b<turn x>") for k in range(1, 14)]
    turns += [(None, None, None, None), (9, 1, "user>", ""), (9, 1, "user>", ""), (10, 5, "assistant", "x" * 9000), (10, 300, "assistant", "later block")]
    df = queries.with_probe(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("end", F.lit("clash")))
    said = r"\### Assistant: </turn> ok"
    turns += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    made = chat.windows(df)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    by = defaultdict(list)
    for c, k, role, text in turns:
        by[c].append((-1 if k is None else k, role or "", text or ""))
    for c, ts in by.items():
        ts.sort()
        loss = "".join(t for _, role, t in ts if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(ts) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in ts).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert len(got) == len(by)
    windows = made.where("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 2 and all("Be \\lbrief> \\bl" in w["formatted"] for w in windows) and any(w["context"] > 1 for w in windows)
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def plain_components(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    groups = defaultdict(list)
    for n in nodes:
        groups[find(n)].append(n)
    return {n: min(g) for g in groups.values() for n in g}


def test_components(spark):
    from pulsegrid.llm.graph import components

    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == plain_components(pairs, nodes)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_brute(some):
    h, w, n = nearcopies.shingles([nearcopies.words_of(t or "") for _, t in some])
    ends = np.cumsum(n)
    parts = [(h[e - k : e], w[e - k : e]) for k, e in zip(n, ends)]
    pairs = [(some[i][0], some[j][0]) for i in range(len(some)) for j in range(i) if (some[i][1] or "") == (some[j][1] or "") or nearcopies.similarity(*parts[i], *parts[j]) >= 0.8]
    return plain_components(pairs, [i for i, _ in some])


def test_near_copies(docs, rows, none):
    got = {r["doc_id"]: r["class_id"] for r in nearcopies.near_copies(docs).where("doc_id is not null").collect()}
    want = near_brute([(i, t) for i, t in rows if i is not None])
    assert {k: got[k] for k in want} == want
    assert nearcopies.near_copies(docs).count() == len(rows) and nearcopies.near_copies(none).count() == 0
    left = nearcopies.drop_near_copies(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {*want.values(), None}


def test_near_copies_in_a_large_group(spark):
    rng = random.Random(5)
    base, some = sentence(rng, 150).split(), []
    for i in range(300):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            t[rng.randrange(150)] = sentence(rng, 1)
        some.append((i, " ".join(t)))
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in nearcopies.near_copies(df).collect()}
    want = near_brute(some)
    # banding sees a pair at the threshold with a chance of 0.9997, and its links come in chains
    assert sum(got[k] != want[k] for k in want) <= 2


def test_substring(docs, rows, none):
    got = substring.substring_dedup(docs)
    assert got.columns == [*docs.columns, "_removed"]
    texts = defaultdict(list)
    for r in got.collect():
        texts[r["doc_id"]].append(r["text"])
    assert texts[0] == [None] and texts[1] == [""] and texts[3] == ["!!!"] and sum(map(len, texts.values())) == len(rows)
    assert texts[12] == [""]  # equals an earlier text
    passage = dict(rows)[16].split()[:70]
    holding = [i for i in (15, 16) if " ".join(passage[20:50]) in texts[i][0]]
    assert holding == [15]
    assert texts[9] == [dict(rows)[9]] and texts[14] == [dict(rows)[14]]
    assert substring.substring_dedup(none).count() == 0
    first = {r["doc_id"]: r["text"] for r in got.where("doc_id = 8").collect()}
    assert first[8] == dict(rows)[8]  # repeated rows are one document


def test_lines(spark):
    rng = random.Random(6)
    a, b = sentence(rng, 14), sentence(rng, 14)
    typo = a[:30] + "q" + a[31:]
    some = [(1, f"{a}\n{b}\n\n--"), (2, f"{sentence(rng, 12)}\n{a.upper()}\n--"), (3, None), (4, ""), (5, f"{b}!\n{b}\nnew line here")]
    out = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in lines.line_dedup(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    assert out[1] == (some[0][1], []) and out[2][1] == [1] and out[3] == (None, []) and out[4] == ("", [])
    assert out[5] == ("new line here", [0, 1])
    h = lines.simhashes([lines.normalised(a), lines.normalised(typo)])
    assert lines.edit_similarity(lines.normalised(a), lines.normalised(typo)) > 0.9 and len(h) == 2
    assert lines.line_dedup(spark.createDataFrame([], "doc_id long, text string, removed_lines int")).columns[-1] == "_removed_lines"


def test_lines_link_near_ones(spark):
    rng = random.Random(7)
    base = sentence(rng, 40)
    some = [(0, base)] + [(i, base[:k] + "z" + base[k + 1 :]) for i, k in enumerate(rng.sample(range(len(base)), 30), 1)]
    out = lines.line_dedup(spark.createDataFrame(some, "doc_id long, text string")).where("size(removed_lines) = 0").count()
    assert out <= 4  # ten buckets find most of them, and chains the rest


def changed(rng, t, n):
    """t with n characters changed, taken out or put in, at places of their own."""
    out = list(t)
    for k in rng.sample(range(len(t)), n):
        out[k] = rng.choice([rng.choice("klmnopqrstuvwxyz"), "", out[k] + rng.choice("klmnopqrstuvwxyz")])
    return "".join(out)


def test_lines_against_all_pairs(spark):
    """Every pair of lines of 20 to 400 characters is compared; 1 character to 10% of them changed."""
    rng = random.Random(8)
    some = []
    for length in (20, 30, 45, 70, 100, 150, 250, 400):
        for share in (0.0, 0.02, 0.05, 0.1):
            for _ in range(6):
                t = sentence(rng, length)[:length].strip().ljust(length, "j")
                some += [t, changed(rng, t, max(1, int(share * length)))]
    said = [lines.normalised(t) for t in some]
    out = lines.line_dedup(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(3))
    stay = {r["doc_id"] for r in out.where("size(removed_lines) = 0").collect()}
    pairs = [(i, j) for j in range(len(said)) for i in range(j) if lines.edit_similarity(said[i], said[j]) >= lines.THRESHOLD]
    want = {i for i, label in {**{i: i for i in range(len(said))}, **plain_components(pairs, {i for p in pairs for i in p})}.items() if i == label}
    assert len(pairs) > 180 and want <= stay and len(stay - want) <= 2


def test_line_keys_travel_packed_and_in_rounds(spark, monkeypatch):
    """A key takes less than 14 bytes on its way, and the parts are compared in rounds with the same links."""
    rng = random.Random(28)
    some = [sentence(rng, 30) for _ in range(400)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(lines.normalised(t) for t in some)], "id long, said string").coalesce(1)
    packed = lines.packed_keys(table, 1).selectExpr("sum(length(keys) + length(ids) + length(sizes) + length(places)) as n", "sum(length(ids)) / 8 as keys").first()
    assert packed["n"] / packed["keys"] < 14
    some += [changed(rng, t, 3) for t in some]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    monkeypatch.setattr(lines, "PART", 20)
    monkeypatch.setattr(lines, "ROUND_PARTS", 1)
    stay = lines.line_dedup(docs).where("size(removed_lines) = 0").select("doc_id").collect()
    assert {r["doc_id"] for r in stay} == set(range(400))


def test_line_search_leaves_no_tables_behind(spark, monkeypatch):
    """What the search writes for itself goes when its links are found: the lines, links and groups stay."""
    where = Path(common.shared_dir(spark).removeprefix("file:"))
    monkeypatch.setattr(lines, "PART", 20)
    monkeypatch.setattr(lines, "ROUND_PARTS", 1)
    rng, before = random.Random(29), {p.name for p in where.iterdir()}
    some = [sentence(rng, 20) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(some + [changed(rng, t, 2) for t in some])), "doc_id long, text string")
    assert lines.line_dedup(docs).where("size(removed_lines) = 0").count() == 60
    columns = [set(spark.read.parquet(str(p)).columns) for p in where.iterdir() if p.name not in before and (p / "_SUCCESS").exists()]
    assert {"doc_id", "line", "words", "said"} in columns and {"u", "v"} in columns
    assert not [c for c in columns if "key" in c or "of_part" in c]


def test_lines_decide_whole_buckets(spark, monkeypatch):
    """Lines that share a passage fill large buckets; near ones among them are found wherever they are in it."""
    monkeypatch.setattr(lines, "BLOCK", 7, raising=False)
    monkeypatch.setattr(lines, "PART", 20, raising=False)
    rng = random.Random(10)
    passage, some = sentence(rng, 20)[:40], []
    for _ in range(40):
        t = f"{passage} {sentence(rng, 30)[:60]}".strip()
        some += [t, changed(rng, t, 3)]
    said = [lines.normalised(t) for t in some]
    pairs = [(i, j) for j in range(len(said)) for i in range(j) if lines.edit_similarity(said[i], said[j]) >= lines.THRESHOLD]
    groups = plain_components(pairs, range(len(said)))
    out = lines.line_dedup(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"))
    assert {r["doc_id"] for r in out.where("size(removed_lines) = 0").collect()} == set(groups.values())


def test_language_query(spark, small):
    out = queries.op2_language_id(spark, small)
    truth = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    right = out.join(truth, "doc_id").where("held_out and lang is not null").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.95 and out.count() == truth.count()


def test_language_edges(docs, none, rows):
    model = langid.learn(none, PIECES)
    assert {r["lang_pred"] for r in langid.identify(docs, model).collect()} == {"und"}
    model = langid.learn(docs, PIECES)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    assert out[0] == out[1] == out[3] == ("und", 0.0) and out[9][0] == "en" and langid.identify(none, model).count() == 0


def test_toxicity_edges(docs, none, rows):
    model = toxicity.learn(none, docs.select("doc_id", F.lit(1).alias("toxic")))
    out = toxicity.score(docs, model, [F.col(c) for c in docs.columns])
    assert out.columns == [*docs.columns, "score", "predicted"] and out.count() == len(rows) and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(none, model, [F.col("doc_id")]).count() == 0


def test_toxicity_in_the_middle_of_a_long_run():
    rng = random.Random(9)
    clean = [sentence(rng, 40) for _ in range(120)]
    bad = "xyzzyx vwuvwu zyxwvz wuvxyz"
    texts = clean + [f"{t[:80]} {bad} {t[80:]}" for t in clean]
    model = toxicity.fit(texts, np.array([False] * 120 + [True] * 120))
    for joint in ("_", ""):
        run = sentence(rng, 200).replace(" ", joint)
        said = bad.replace(" ", joint)
        toxic = run[:500] + joint + said * 8 + joint + run[500:]
        without, within = model.score([run, toxic])
        assert without < 0.5 < within
    for n in (40, 41, 60, 61, 99, 1000):
        w = sentence(rng, n).replace(" ", "")[:n]
        pieces_ = toxicity.words_of(w)
        assert max(map(len, pieces_)) <= 40 and all(any(w[i : i + 20] in x for x in pieces_) for i in range(n - 19))


def test_toxicity_query(spark):
    """Held-out rows, some of whose labels are noise: toxic ones score higher, most are caught, few clean ones are."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    out = queries.op6_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out")
    rows = [(r["toxic"], r["score"], r["predicted"]) for r in out.collect()]
    bad, good = ([(s, p) for t, s, p in rows if t == k] for k in (1, 0))
    order = np.argsort(np.argsort([s for s, _ in bad + good], kind="stable"))
    above = (order[: len(bad)].mean() - (len(bad) - 1) / 2) / len(good)
    assert len(bad) > 100 and above > 0.9 and np.mean([p for _, p in bad]) > 0.55 and np.mean([p for _, p in good]) < 0.05


def plain_cut(found, keep=lambda i: True):
    """Texts by id without passages that an earlier text has, chunk by chunk: the plain version of substring dedup."""
    seen, out = set(), {}
    for i, t in sorted(found.items()):
        raw = (t or "").encode()
        ends, spans = substring.ends_of(raw), []
        for a, b in zip([0, *ends], ends):
            if raw[a:b] in seen:
                spans.append((a, b - a))
            seen.add(raw[a:b])
        out[i] = (t if t is None else substring.cut(raw, spans)[0], sum(b - a for a, b in substring.cut(raw, spans)[1]))
    return out


def plain_near(found):
    """The smallest id of each document's component by probability Jaccard over all pairs."""
    ids = [i for i, t in found.items() if nearcopies.words_of(t or "")]
    h, w, n = nearcopies.shingles([nearcopies.words_of(found[i]) for i in ids])
    at = np.concatenate([[0], np.cumsum(n)])
    texts = [(h[i:j], w[i:j].astype(np.int32)) for i, j in zip(at, at[1:])]
    may = nearcopies.bounds(texts, texts) >= nearcopies.THRESHOLD - 1e-3
    pairs = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(may)) if i < j and nearcopies.similarity(*texts[i], *texts[j]) >= nearcopies.THRESHOLD]
    empty = defaultdict(list)
    for i in found.keys() - set(ids):
        empty[found[i] or ""].append(i)
    pairs += [(min(v), i) for v in empty.values() for i in v if i != min(v)]
    return {**{i: i for i in found}, **plain_components(pairs, {i for p in pairs for i in p})}


def test_substring_query_against_plain_chunks(spark, small):
    found = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["text"], r["removed_bytes"]) for r in queries.op1_substring_dedup(spark, small).collect()}
    assert got == plain_cut(found) and sum(n for _, n in got.values()) > 0


def test_drop_copies_of_rows_in_another_order(spark):
    rows = [(i, f"text {i % 100}", "x") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_at string").repartition(3)
    kept = exact.drop_copies(docs.withColumn("more", F.lit(1))).collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == {(i, f"text {i % 100}") for i in range(100, 200)} and len(kept) == 100


def test_index_answers_history_and_new_rows(spark):
    """Copies within the history, within the new rows, and across them."""
    texts = {1: "a", 2: "a", 3: "b", 4: "c", 11: "A", 12: "d", 13: "d", 14: "b", 15: "e"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["in_history_index"]) for r in exact.exact_dedup(docs, in_history=F.col("doc_id") < 10).collect()}
    assert got == {1: (11, 3, False, True), 2: (11, 3, False, True), 11: (11, 3, True, True), 3: (14, 2, False, True), 14: (14, 2, True, True), 4: (4, 1, True, True), 12: (13, 2, False, False), 13: (13, 2, True, False), 15: (15, 1, True, False)}


def test_neighbours_with_a_far_id(spark, monkeypatch):
    """One far id does not put all others in one block, and every row has its own next one."""
    monkeypatch.setattr(fingerprints, "BLOCK", 50)
    ids = [*range(2000), 10**12, -(10**12)]
    docs = spark.createDataFrame([(i, f"text of {i}") for i in ids] + [(None, "none")], "doc_id long, text string").repartition(5)
    bounds = fingerprints.block_bounds(docs.select("doc_id"))
    sizes = np.bincount(np.searchsorted(bounds, ids))
    assert len(bounds) > 30 and sizes.max() < 200
    got = {r["doc_id"]: r for r in fingerprints.neighbours(docs).collect()}
    order = [*sorted(ids, reverse=True), None]
    said = {**{i: f"text of {i}" for i in ids}, None: "none"}
    for i, after in zip(order, [*order[1:], order[0]]):
        t, u = said[i], said[after]
        half = len(t) // 2
        assert got[i]["edited"] == t[: len(t) - half] + u[:half]
        assert got[i]["near_next"] == pytest.approx(fingerprints.likeness([fingerprints.digest(t.encode())], [fingerprints.digest(u.encode())])[0])


def test_near_copies_outside_the_largest_component(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 5)
    monkeypatch.setattr(nearcopies, "PART", 20)
    rng = random.Random(21)
    base = sentence(rng, 200).split()
    found = {}
    for i in range(60):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3, 9, 10, 11])):
            t[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        found[i] = " ".join(t)
    got = {r["doc_id"]: r["class_id"] for r in nearcopies.near_copies(spark.createDataFrame(list(found.items()), "doc_id long, text string")).collect()}
    want = plain_near(found)
    # banding may miss a pair at the threshold; what is joined is right
    assert all(want[got[i]] == want[i] for i in got) and sum(got[i] != want[i] for i in got) <= 1


def test_line_edges(spark):
    """Null ids, repeated rows, a very long line, clashing names, and keys that are common among the lines packed together."""
    rng = random.Random(22)
    long = sentence(rng, 20_000)
    many = [f"{i} {sentence(rng, 4)} the common words that many of these lines have in them {sentence(rng, 12)}" for i in range(300)]
    some = [(None, "the same line of words here"), (1, "the same line of words here\nanother"), (2, long), (3, long[:60_000] + "x" + long[60_000:]), (4, None), (4, ""), (5, "!!\n\n--"), (6, "twice over in this text\ntwice over in this text"), (6, "twice over in this text\ntwice over in this text")]
    some += [(10 + i, t) for i, t in enumerate(many)] + [(400 + i, changed(rng, t, 2)) for i, t in enumerate(many)]
    docs = spark.createDataFrame([(i, t, 1, "s", "w") for i, t in some], "doc_id long, text string, removed_lines int, stays string, words string").repartition(3)
    lines_ = lines.HOT
    try:
        lines.HOT = 20
        out = lines.line_dedup(docs)
        rows = [(r["doc_id"], r["text"], r["_removed_lines"]) for r in out.collect()]
    finally:
        lines.HOT = lines_
    assert out.columns == [*docs.columns, "_removed_lines"] and len(rows) == len(some)
    by = defaultdict(list)
    for i, t, n in rows:
        by[i].append((t, n))
    assert by[None] == [("the same line of words here", [])] and by[1] == [("another", [0])] and by[2] == [(long, [])] and by[3] == [("", [0])]
    assert sorted(by[4], key=str) == sorted([(None, []), ("", [])], key=str) and by[5] == [("!!\n\n--", [])] and by[6] == [("twice over in this text", [1])] * 2
    assert all(by[10 + i] == [(t, [])] and by[400 + i] == [("", [0])] for i, t in enumerate(many))


def test_pipeline(spark, small):
    """Each stage on the real output of the one before, against a plain version (for the first: given the scores)."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    pairs = lambda df: {r[0]: r[1] for r in df.select("doc_id", "text").collect()}
    before = pairs(docs)
    clean = stage["toxicity"](spark, docs, small)
    model = queries.toxicity_model(spark, docs, small)
    scores = dict(zip(before, model.score([t or "" for t in before.values()])))
    after = pairs(clean)
    assert clean.columns == docs.columns and after == {i: before[i] for i in before if scores[i] < toxicity.THRESHOLD}
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "toxic").collect()}
    assert sum(i in after for i in before if labels.get(i) == 0) > 0.95 * sum(labels.get(i) == 0 for i in before)

    single = stage["exact_dedup"](spark, clean, small)
    last = {}
    for i, t in sorted(after.items()):
        last["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")] = i
    after = pairs(single)
    assert single.columns == docs.columns and set(after) == set(last.values())

    apart = stage["near_dedup"](spark, single, small)
    labels = plain_near(after)
    kept, want = pairs(apart), {i for i in after if labels[i] == i}
    assert apart.columns == docs.columns and want <= set(kept) and len(set(kept) - want) <= 1 and len(want) < len(after)

    cut = stage["substring_dedup"](spark, apart, small)
    plain = {i: t for i, (t, gone) in plain_cut(kept).items() if not gone or t}
    after = pairs(cut)
    assert cut.columns == docs.columns and after == plain

    packed = stage["packing"](spark, cut, small).collect()
    ids = {i: [*packing.encoder(WORDS).library.encode(t or "", add_special_tokens=False).ids, packing.END] for i, t in after.items()}
    rows, sequences = defaultdict(list), defaultdict(list)
    for r in packed:
        rows[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, some in rows.items():
        at = 0
        for r in sorted(some, key=lambda r: r["start"]):
            part = np.array(ids[i][at : at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["doc_tokens"] == len(ids[i]) and r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids[i])
    assert rows.keys() == after.keys()
    for some in sequences.values():
        ends = np.cumsum([n for _, n in sorted(some)])
        assert [o for o, _ in sorted(some)] == [0, *ends[:-1].tolist()] and ends[-1] <= packing.WINDOW
    run = corpus_pipeline.run(spark, small)
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in run.collect()} == {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed}


def test_pipeline_edges(spark, docs, none, small):
    """Awkward rows, extra and clashing columns, and an empty table go through every stage."""
    import corpus_pipeline

    for start in (docs, none):
        left = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, left, small)
            rows = out.collect()
            assert name == "packing" or out.columns == docs.columns
            left = spark.createDataFrame(rows, out.schema)
        assert bool(rows) == (start is docs)
