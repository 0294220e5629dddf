"""The text operators against plain versions on small tables with nulls, empty texts, ties and repeated rows."""

from __future__ import annotations

import base64
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from throughline.llm import bpe, caps, chat, decontaminate, hmm, langid, lines, runindex, simhash, toxicity
from throughline.llm.frames import read
from throughline.llm.queries import BYTE_BPE

DOCS = "doc_id long, text string"


def find(links, nodes):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '.', ',', 'é'])}" for _ in range(n))


# 1

def test_bpe_equals_tiktoken(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    cases = [None, "", " ", "<|endoftext|>", "a" * 3000, "ab" * 2500 + "é" * 900, "  \x1c ²Ⅷ'll", "".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(4000)),
             *["".join(rng.choice("aeinrst hlod'") for _ in range(300)) for _ in range(40)]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], f"{DOCS}, ids string")
    coded = bpe.encode(df, BYTE_BPE, P.PATTERN)
    got = {r.doc_id: r for r in bpe.decode(coded, BYTE_BPE).collect()}
    for i, t in enumerate(cases):
        assert got[i].ids == known.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()
    odd = spark.createDataFrame([(1, [10**6, None, 64]), (2, None)], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(odd, BYTE_BPE).orderBy("doc_id").collect()] == [("�" * 2).encode() + bpe.Decoder(ranks)[64], b""]


def test_bpe_pairs_by_parts_equal_pairs_by_merges():
    ranks = bpe.load_ranks(BYTE_BPE)
    encoder, rng = bpe.Encoder(ranks, P.PATTERN), random.Random(3)
    assert encoder.ordered
    reached = [r for t, r in ranks.items() if len(t) == 1 or t in encoder.halves]
    for _ in range(20_000):
        a, b = rng.choice(reached), rng.choice(reached)
        assert encoder.compatible((a, b)) == (bpe.merged(encoder.token[a] + encoder.token[b], ranks) == [encoder.token[a], encoder.token[b]])


# 7

def test_chat_reads_back_any_text(spark):
    rng = random.Random(1)
    bits = ["\\", "### Assistant: ", "</turn>", "### Role x%3A: ", "\n", "a", "%0A", "### User:", ""]
    for _ in range(3000):
        role, text = rng.choice(["user", "assistant", "odd: %\n", "Role x", ""]), "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        written, _ = chat.render(role, text)
        assert list(chat.parse(written)) == [(role, text)]
        assert list(chat.parse(written * 2)) == [(role, text)] * 2
    with pytest.raises(ValueError):
        list(chat.parse("### User: open"))
    rows = [(1, 0, "user", None), (1, 1, "assistant", "é\\"), (1, 1, "assistant", "é\\"), (None, 0, None, "x"), (2, None, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns, got[2].loss_chars) == (3, 4, 1, 0)
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


# 4

def test_hmm_base_counts_and_exact_likelihood(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(60))) for i in range(60)] + [(60, None), (61, ""), (5, "w1 W1"), (5, "w1 W1"), (None, "new")]
    df = spark.createDataFrame(rows, DOCS).withColumn("word", F.lit(1))
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    got = hmm.score(df, train).collect()
    learn = [t for i, t in rows if i is not None and i % 3]
    c = Counter(w for t in learn for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        want[i, len(tokens), sum(c[w] > 0 for w in tokens), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    draw = np.random.default_rng(1)
    model = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), draw.dirichlet(np.ones(5), 2).T)
    seqs = [np.array(s) for s in ([0], [1, 2, 3, 4, 0], [3, 3, 1])]
    steps = hmm.Steps(seqs)
    logs = np.empty(3)
    logs[steps.order] = steps.forward(model.start, model.move, model.emit, keep=False)[0]
    for s, log in zip(seqs, logs, strict=True):
        a = model.start * model.emit[s[0]]
        for x in s[1:]:
            a = a @ model.move * model.emit[x]
        assert math.isclose(log, math.log10(a.sum()), rel_tol=1e-9)
    counts = model.expect(seqs)
    assert math.isclose(counts[:2].sum(), 3, rel_tol=1e-4) and math.isclose(counts[2:6].sum(), 6, rel_tol=1e-4)
    assert np.allclose(counts[6:].reshape(5, 2).sum(1), np.bincount(np.concatenate(seqs), minlength=5), rtol=1e-4)
    assert hmm.score(df.limit(0), train).count() == 0


# 6

@pytest.mark.parametrize("crowd", [1, 64])
def test_simhash_components(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(4)
    rows = [(i, prose(rng, 40)) for i in range(40)]
    rows += [(100 + i, rows[i % 5][1] + f" extra{i}") for i in range(25)] + [(200, None), (201, ""), (202, " \t"), (3, rows[3][1]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("x"))

    def plain(t):
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {t: plain(t) for _, t in rows}
    label = find([(a, b) for a, b in combinations(set(fps.values()), 2) if (a ^ b).bit_count() <= 2], set(fps.values()))
    first = {}
    for i, t in rows:
        if i is not None:
            first[label[fps[t]]] = min(i, first.get(label[fps[t]], i))
    got = simhash.groups(df).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == Counter((i, fps[t], first[label[fps[t]]]) for i, t in rows)
    assert simhash.groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8, 8192])
def test_pipeline_near_copies_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(12)
    rows = [(i, prose(rng, n, 400)) for i, n in enumerate([3, 5, 8, 9, 14, 25, 40, 60, 90, 200, 400, 700])]
    for i, t in rows[:12]:
        for k in range(8):
            w = t.split()
            for _ in range(rng.randrange(1, 2 + len(w) // 35)):
                w[rng.randrange(len(w))] = f"other{rng.randrange(9)}"
            rows.append((100 + 10 * i + k, " ".join(w[:len(w) - rng.randrange(1 + len(w) // 20)])))
    rows += [(300, None), (301, ""), (302, rows[3][1].upper()), (None, rows[4][1]), (3, rows[3][1])]

    def plain(t):
        w = (t or "").encode().lower().split()
        return tuple(sorted({b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))})) if w else ()

    sets = {t: plain(t) for _, t in rows}
    linked = [(a, b) for a, b in combinations(set(sets.values()), 2) if len(set(a) & set(b)) >= 0.8 * len({*a, *b})]
    label = find(linked, set(sets.values()))
    ids = {}
    for i, t in rows:
        if i is not None:
            ids[label[sets[t]]] = min(i, ids.get(label[sets[t]], i))
    assert len(linked) > 40
    got = Counter((r.doc_id, r.component_id) for r in simhash.copies(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter((i, ids[label[sets[t]]]) for i, t in rows)
    docs = spark.createDataFrame(rows, DOCS)
    want = {i for i, t in rows if i is not None and i == ids[label[sets[t]]]}
    assert {r.doc_id for r in corpus_pipeline.dedup_near_copies(spark, docs, "").collect()} - {None} == want


@pytest.mark.parametrize("crowd", [2, 64])
def test_near_copies_meet_on_a_ring(spark, monkeypatch, crowd):
    """Unrelated texts of like size are not compared; all similar pairs share a key and keep its chain's budgets; crowded keys lose none."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(21)
    base = [prose(rng, 20 + 12 * i, 10**6) for i in range(40)]
    texts = list(base)
    for t in base[3:15]:
        for k in range(6):
            w = t.split()
            for _ in range(rng.randrange(1, 2 + len(w) // 60)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    sets = list({s.tobytes(): s for s in (simhash.shingle_set(t, 5) for t in texts)}.values())
    linked = {(a, b) for a, b in combinations(range(len(sets)), 2)
              if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    bucket = np.array([int(math.log(len(s)) / simhash.bucket_width(0.8) // 1) for s in sets])
    key, sid, chain, filled, apart = simhash.chains(np.arange(len(sets)), bucket, sets, 0.8)
    met, under = set(), {}
    for i, k in enumerate(key.tolist()):
        under.setdefault(k, []).append(i)
    for at in under.values():
        for i, j in combinations(at, 2):
            if simhash.within_budgets(chain[[i]], chain[[j]], np.maximum(filled[[i]], filled[[j]]), apart[[i]])[0]:
                met.add((min(sid[i], sid[j]), max(sid[i], sid[j])))
    assert len(linked) > 60 and linked <= met and len(met) < len(sets) * (len(sets) - 1) / 2 / 8
    compared = []
    near = simhash._near
    monkeypatch.setattr(simhash, "_near", lambda items, *a: compared.append(items.select("sid").distinct().count()) or near(items, *a))
    got = {r.doc_id: r.component_id for r in simhash.copies(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    place = {s.tobytes(): i for i, s in enumerate(sets)}
    label = find(linked, range(len(sets)))
    least = {}
    of = [label[place[simhash.shingle_set(t, 5).tobytes()]] for t in texts]
    for i, c in enumerate(of):
        least.setdefault(c, i)
    assert got == {i: least[c] for i, c in enumerate(of)} and all(n < len(sets) - 25 for n in compared)


def test_simhash_links_take_any_radius(spark):
    rng = random.Random(13)
    fps = [rng.getrandbits(64) - 2**63 for _ in range(12)]
    fps += [(f ^ sum(1 << b for b in rng.sample(range(64), 7)) + 2**63) % 2**64 - 2**63 for f in fps]
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 7).collect()}
    assert got == {(min(a, b), max(a, b)) for a, b in combinations(fps, 2) if ((a ^ b) % 2**64).bit_count() <= 7}


@pytest.mark.parametrize("n, dim", [(1_000, 2), (51_000, 64), (10_000_000, 64), (10_000_000, 256)])
def test_caps_recall_does_not_fall_with_the_table(n, dim):
    """Pairs at the threshold, drawn apart from those that chose the number of filters."""
    code = caps.Code(n, dim, caps.plan(n, dim, 0.9))
    assert caps.recall(code, dim, 0.9, draws=1000, seed=7) > 0.98


def test_caps_decode_all_filters_above_the_bound():
    code = caps.Code(20_000, 12, 40)
    x = caps.unit(np.random.default_rng(3).normal(size=(5, 12)))
    turned = x @ code.rotation
    a, b, c, d = (turned[:, p] @ w.T for p, w in zip(code.parts, code.words, strict=True))
    every = a[:, :, None, None, None] + b[:, None, :, None, None] + c[:, None, None, :, None] + d[:, None, None, None, :]
    best = np.sort(np.argsort(-every.reshape(5, -1), axis=1)[:, :40], axis=1)
    assert (code.passed(x) == best).all()


@pytest.mark.parametrize("run", [1, 3, 7, 64, 512])
def test_hmm_counts_are_those_of_whole_texts(run):
    """Expected counts do not depend on where long texts are cut; held against the textbook recursion in plain loops."""
    draw = np.random.default_rng(5)
    lex = hmm.Lexicon({}, draw.integers(1, 50, 12).astype(float), np.ones(12), 300, 12)
    model = hmm.Model.next(draw.gamma(1.0, 5.0, 8 + 64 + 96), lex)
    seqs = [draw.integers(0, 12, n).astype(np.int32) for n in (1, 2, 7, 30, 200, 64, 1)]
    starts, moves, emits = np.zeros(8), np.zeros((8, 8)), np.zeros((12, 8))
    for s in seqs:
        ahead = [model.start * model.emit[s[0]]]
        for c in s[1:]:
            ahead.append((ahead[-1] @ model.move) * model.emit[c])
        back = [np.ones(8)]
        for c in s[:0:-1]:
            back.insert(0, model.move @ (model.emit[c] * back[0]))
        p = ahead[-1].sum()
        starts += ahead[0] * back[0] / p
        for t, c in enumerate(s):
            emits[c] += ahead[t] * back[t] / p
            if t:
                moves += np.outer(ahead[t - 1], model.emit[c] * back[t]) * model.move / p
    want = np.concatenate([starts, moves.ravel(), emits.ravel()])
    np.testing.assert_allclose(model.expect(seqs, run), want, rtol=1e-4, atol=1e-5)


def test_hmm_training_takes_no_logarithms(monkeypatch):
    """A pass of training needs expected counts alone: no likelihood is computed beside them."""
    draw = np.random.default_rng(6)
    lex = hmm.Lexicon({}, draw.integers(1, 50, 12).astype(float), np.ones(12), 300, 12)
    model = hmm.Model.next(draw.gamma(1.0, 5.0, 8 + 64 + 96), lex)
    taken, log10 = [], np.log10
    monkeypatch.setattr(np, "log10", lambda x: taken.append(1) or log10(x))
    seqs = [draw.integers(0, 12, n).astype(np.int32) for n in (900, 1500, 40)]
    assert model.expect(seqs).sum() > 0 and not taken
    assert hmm.Steps(seqs).forward(model.start, model.move, model.emit, keep=False)[0].max() < 0 and len(taken) == 1500


# 8

def test_caps_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 16)
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(6, 24))
    x = [*(centres[i % 6] + draw.normal(size=24) * 0.25 for i in range(150)), *draw.normal(size=(100, 24))]
    rows = [(i, [float(v) for v in np.float32(y)]) for i, y in enumerate(x)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [0.0] * 24), (304, [float("nan")] * 24), (305, [None] * 24), (306, []), (307, [1.0]), (308, [float("inf")] * 24), (309, [1e30 * v for v in rows[1][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))
    good = {i: np.array(v, float) for i, v in rows if v and len(v) == 24 and all(e is not None and math.isfinite(e) for e in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = {(a, b) for a, b in combinations(unit, 2) if unit[a] @ unit[b] >= 0.9}
    n = Counter(i for pair in links for i in pair)
    got = {r.vec_id: r for r in caps.near_duplicates(df).collect()}
    assert len(got) == len(rows) and all(got[i].n_links <= n[i] for i, _ in rows)
    assert sum(r.n_links for r in got.values()) >= 0.9 * 2 * len(links) > 100
    label = find(links, [i for i, _ in rows])
    assert sum(got[i].component_id == label[i] for i, _ in rows) >= 0.95 * len(rows)
    assert all(got[i].n_links == 0 and got[i].kept for i in (302, 303, 304, 305, 306, 307, 308))
    assert caps.near_duplicates(df.limit(0)).count() == 0


# 10

@pytest.mark.parametrize("crowd", [1, 256])
def test_run_index_against_all_windows(spark, monkeypatch, crowd):
    monkeypatch.setattr(runindex, "CROWD", crowd)
    size, rng = 130, random.Random(6)
    base = prose(rng, 400, 400)
    texts = [prose(rng, 80, 400) for _ in range(6)] + [prose(rng, 9, 400) + base[a:a + n] + prose(rng, 9, 400) for a, n in [(0, 129), (0, 130), (5, 140), (40, 400), (41, 300), (300, 500)]]
    texts += [None, "", "short", "ab" * 200, "ab" * 70, base[:260] + "é" + base[:260], texts[0]]
    rows = [*enumerate(texts), (1, texts[1])]
    df = spark.createDataFrame(rows, DOCS).withColumn("h", F.lit(1))
    seen = Counter(b[i:i + size] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - size + 1))
    want = Counter()
    for i, t in rows:
        b, cover = (t or "").encode(), bytearray(len((t or "").encode()))
        for a in range(len(b) - size + 1):
            if seen[b[a:a + size]] > 1:
                cover[a:a + size] = b"\1" * size
        want[i, len(b), sum(1 for s in bytes(cover).split(b"\0") if s), bytes(x for x, y in zip(b, cover, strict=True) if not y)] += 1
    got = runindex.remove(df, length=size).collect()
    assert Counter((r.doc_id, r.n_bytes, len(r.removed) // 2, bytes(r.kept)) for r in got) == want
    assert runindex.remove(df.limit(0), length=size).count() == 0


# 2

@pytest.mark.parametrize("crowd", [2, 32])
def test_line_dedup_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(lines, "CROWD", crowd)
    rng = random.Random(8)
    pool = [prose(rng, 30, 500) for _ in range(12)]
    variants = [p[:k] + "#" + p[k + 1:] for p in pool[:4] for k in range(5, 100, 12)]
    rows = [(i, "\n".join(rng.choice(pool + variants + ["", "tiny", " tiny\t"]) for _ in range(rng.randrange(1, 7)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, pool[0])]
    df = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(1)).withColumn("lid", F.lit(2))
    places = [(i is None, i, k, x.strip(lines.BLANK)) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip(lines.BLANK)]
    different = sorted({p[3] for p in places})
    label = find([(a, b) for a, b in combinations(different, 2) if lines.jaccard(a, b) >= 0.8], different)
    gone, seen = set(), set()
    for _, i, k, x in sorted(places, key=lambda p: (p[0], p[1] or 0, p[2])):
        gone |= {(i, k)} if label[x] in seen else set()
        seen.add(label[x])
    got = {r.doc_id: r for r in lines.dedup(df).collect()}
    assert len(got) == len(rows) and got[50].kept is None and got[1].lid == 2
    for i, t in rows[:40] + rows[41:]:
        assert got[i].kept == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
    assert lines.dedup(df.limit(0)).count() == 0


def test_lines_with_a_changed_word_or_letter_are_linked(spark):
    rng, five = random.Random(15), lambda x: {x[i:i + 5] for i in range(len(x) - 4)}
    rows, near = [], 0
    for i in range(120):
        line = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8))) for _ in range(rng.randrange(10, 25)))
        w, at = line.split(), rng.randrange(2, 8)
        other = " ".join(w[:at] + w[at + 1:] if i % 3 == 0 else [*w[:at], "new", *w[at + 1:]]) if i % 3 < 2 else line[:30] + "#" + line[31:]
        if len(five(line) & five(other)) >= 0.8 * len(five(line) | five(other)):
            rows += [(2 * i, line), (2 * i + 1, other)]
            near += 1
    got = lines.dedup(spark.createDataFrame(rows, DOCS)).filter("n_removed = 1 and doc_id % 2 = 1").count()
    assert near > 60 and got >= 0.97 * near


def test_lines_that_only_share_a_key_are_not_paired(spark):
    rng, radius = random.Random(21), lines.sketch_radius(0.8)
    pool = ["".join(rng.choice(["th", "on", "er", "in", "ea", " ", "ou", "st", "ha", "re", "an", "or", "ti", "wh"]) for _ in range(300)) for _ in range(12)]
    pool += [p[:100] + "#" + p[101:] for p in pool[:3]]
    near = {(a, b) for a, b in combinations(range(15), 2) if lines.jaccard(pool[a], pool[b]) >= 0.8}
    sketch = lines.bands(pool)[1].tolist()
    table = "key long, lid long, sketch long, times long"
    found = lines._candidates(spark.createDataFrame([(7, i, x, 1) for i, x in enumerate(sketch)], table), radius).collect()
    assert {(r.u, r.v) for r in found} == near == {(0, 12), (1, 13), (2, 14)} and not any(r.crowd for r in found)
    # under a crowded key each line is written once, with the most frequent one
    rows = [(7, 100 * k + i, x, 1 + (k == 1 and i == 0)) for k in range(4) for i, x in enumerate(sketch)]
    found = lines._candidates(spark.createDataFrame(rows, table), radius).collect()
    assert len(found) == 59 and all(r.crowd and 100 in (r.u, r.v) for r in found)
    assert sum(r.near for r in found) == 7


# 3 and 9

def test_similar_lines_by_hashes_are_the_exact_ones():
    draw = random.Random(5)
    left = [" ".join(draw.choice("abcdefgh") * draw.randint(1, 9) for _ in range(draw.randint(1, 150))) for _ in range(400)]
    right = []
    for line in left:
        words = line.split(" ")
        for _ in range(draw.randint(0, 1 + len(words) // 12)):
            words[draw.randrange(len(words))] = "other"
        right.append(" ".join(words) if draw.random() < 0.8 else draw.choice(left))
    exact = [lines.jaccard(a, b) >= 0.8 for a, b in zip(left, right, strict=True)]
    assert 0 < sum(exact) < len(left) and lines.similar(left, right, 0.8).tolist() == exact
    assert lines.similar([], [], 0.8).tolist() == [] and lines.similar(["a", "a"], ["a", "b"], 0.8).tolist() == [True, False]


def test_toxicity_on_held_out_rows(spark):
    rng, bad = random.Random(9), ["vilen", "grumox", "snarkel"]
    def text(grade):
        w = prose(rng, 60, 300).split()
        for _ in range(2 * grade):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "ing", "ed"]))
        return " ".join(w)
    rows = [(i, text(g := rng.choice([0, 0, 0, 1, 2])), g) for i in range(900)]
    df = spark.createDataFrame(rows, f"{DOCS}, truth int").withColumn("grade", F.col("truth")).withColumn("severity", F.lit("x"))
    got = toxicity.predict(df, toxicity.fit(df.filter("doc_id % 3 != 0"))).filter("doc_id % 3 = 0").collect()
    assert np.mean([(r.p_toxic >= 0.5) == (r.truth > 0) for r in got]) > 0.97
    means = [np.mean([r.severity for r in got if r.truth == g]) for g in (0, 1, 2)]
    assert means[0] < 0.2 < means[1] < means[2]
    odd = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "...", None)], f"{DOCS}, grade int")
    assert {(r.severity, r.p_toxic, r.grade) for r in toxicity.predict(odd, toxicity.fit(df.filter("doc_id < 500"))).collect()} == {(0.0, 0.0, 0)}
    assert toxicity.fit(odd) is None and toxicity.predict(odd, None).count() == 3


def test_language_on_held_out_rows(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").withColumn("score", F.lit("x"))
    got = langid.identify(docs, F.col("doc_id") % 3 != 0).filter("doc_id % 3 = 0").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "12 ...", None)], f"{DOCS}, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, F.lit(True)).collect()} == {("und", 0.0)}


# 5

def test_wand_retrieves_all_above_the_threshold(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.randrange(8, 40), 200)) for i in range(60)]
    split = [(i, decontaminate.words(t)) for i, t in items]
    df = Counter(w for _, t in split for w in set(t))
    index = decontaminate.Index(split, df, len(split), sum(len(t) for _, t in split) / len(split))
    for _ in range(60):
        text = decontaminate.words(prose(rng, 30, 200) + " " + " ".join(rng.choice(items)[1].split()[:rng.randrange(40)]))
        terms = sorted({index.vocabulary[w] for w in text if w in index.vocabulary})
        for b in range(index.blocks):
            scores = Counter()
            for t in terms:
                for item, x in index.postings[b].get(t, ()):
                    scores[item] += x
            assert {i for i, _ in index.retrieve(terms, b, 0.3)} == {i for i, s in scores.items() if s >= 0.3}
    docs = [(i, prose(rng, 150, 200)) for i in range(30)]
    docs += [(100 + i, docs[i][1] + " " + items[i][1].upper() + " " + docs[i + 1][1]) for i in range(20)] + [(200, None), (201, "")]
    frame = spark.createDataFrame(docs, DOCS).withColumn("leaks", F.lit(1))
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (None, "x")], "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.find_leaks(frame, bench).collect()}
    assert len(got) == len(docs) and all(i in got[100 + i] for i in range(20)) and not any(got[i] for i in range(30)) and got[200] == got[201] == []
    assert decontaminate.find_leaks(frame, bench.limit(0)).filter("size(leaks) > 0").count() == 0


def test_partial_and_edited_items_are_found(spark):
    rng = random.Random(14)
    items = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(n))) for i, n in enumerate([16, 20, 25, 30, 40, 55] * 3)]
    around = [" ".join(f"w{rng.randrange(900)}" for _ in range(90)) for _ in range(2)]
    docs, want = [], {}
    for i, t in items:
        w = t.split()
        changed = [list(w) for _ in range(3)]
        for k, c in enumerate(changed):
            for at in rng.sample(range(len(w)), k + 1):
                c[at] = "changed"
        mixed = rng.sample(w, len(w))
        for c, found in [(w[:int(len(w) * 0.85)], True), *((c, True) for c in changed), (mixed, False), (w[:len(w) // 4], False)]:
            want[len(docs)] = [i] if found else []
            docs.append((len(docs), f"{around[0]} {' '.join(c)} {around[1]}"))
    found = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in found.collect()} == want


# the pipeline

def test_pipeline_stages(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").withColumn("leaks", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("p_toxic", F.lit(3))
    extra = spark.createDataFrame([(9000, None), (9001, ""), (9002, docs.first().text)], DOCS)
    docs = docs.unionByName(extra, allowMissingColumns=True)
    plain = {r.doc_id: r.text for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, "/root/testdata/sf0.001")
        assert step(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
        if name != "byte_bpe":
            assert out.columns == docs.columns
            docs = out.cache()
            assert {r.doc_id for r in docs.collect()} <= set(plain)
    rows = {r.doc_id: r for r in out.collect()}
    assert 9000 in rows and 9001 not in rows and 9002 not in rows and all(r.exact for r in rows.values())
    items = [b" ".join(decontaminate.words(r.text)) for r in read(spark, "/root/testdata/sf0.001", "benchmark").collect()]
    for r in docs.collect():
        joined = b" " + b" ".join(decontaminate.words(r.text or "")) + b" "
        assert not any(b" " + i + b" " in joined for i in items)


def test_pipeline_keeps_every_text_of_an_id_that_is_no_copy(spark, sf):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c), (3, c), (None, "alone " * 9), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", F.lit(1))
    got = corpus_pipeline.dedup_near_copies(spark, docs, sf).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(
        [(1, a), (2, b), (3, c), (None, "alone " * 9), (4, None), (4, None)], key=str)
    assert got[0].asDict().keys() == {"doc_id", "text", "text_key"}
