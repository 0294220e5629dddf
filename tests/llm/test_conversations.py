"""Structure repair, prefix trie and SentencePiece against plain versions on small tables with nulls, ties, empty and long rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from throughline.llm import pieces, repair, turntrie
from throughline.llm.queries import PIECE_BPE

TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11

def cheapest(rows):
    """All edits tried out: rows of (initial, must go, cut off) to (cost, audit, kept roles), by growing sequences of turns."""
    legal = re.compile(r"(s?(ua)+)?\Z")
    best = {}

    def go(i, out, cost, audit):
        if len(out) > 2 * len(rows) + 2 or cost > 3 * len(rows) or not re.match(r"s?(ua)*u?\Z", out):
            return
        if i == len(rows) and legal.match(out):
            best[audit] = min(cost, best.get(audit, cost))
        for x in "ua":
            go(i, out + x, cost + 2, audit + "I")
        if i < len(rows):
            initial, must, late = rows[i]
            go(i + 1, out, cost + 3, audit + "D")
            if not must:
                go(i + 1, out + initial, cost + late, audit + "K")
                for x in "ua":
                    go(i + 1, out + x, cost + 2 + late, audit + "R")

    go(0, "", 0, "")
    return min((c, a) for a, c in best.items())


def test_every_short_word_is_repaired_at_the_least_cost():
    path, words = repair.Path(), ["".join(w) for n in range(4) for w in product("suaoUAx", repeat=n)]
    for word in sorted(words, key=lambda w: w[::-1]):
        path.go(word[::-1])
        rows = [(c.lower(), c == "x", int(c.isupper())) for c in word]
        assert path.answer() == cheapest(rows), word
    assert path.made == len(words) - 1  # each node once


def plain_report(rows, conv):
    """One conversation by the contract, from its rows (turn, role, text) before the damage."""
    after = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        if harm == 0:
            continue
        role = "user" if harm == 4 else role
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        after += [(turn, role, text)] * (2 if harm == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in after:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    numbers = {t for t, *_ in after if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
    word = "".join("x" if f in ("blank", "duplicate") else (lambda c: c.upper() if f else c)(r[:1] if r[:1] in ("s", "u", "a") else "o")
                   for (_, r, _), f in zip(after, faults))
    path = repair.Path()
    path.go(word[::-1])
    cost, audit = path.answer()
    out, left, led = [], list(after), 0
    for edit in audit:
        _, role, text = left.pop(0) if edit != "I" else (None, None, "")
        if edit == "D":
            continue
        if edit == "K":
            led = led or int(not out and role[:1] == "s")
            out.append(f"{role}:{text}")
        else:
            out.append(f"{'user' if (len(out) - led) % 2 == 0 else 'assistant'}:{text}")
    assert not left
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(out)))


def conversations(seed=5):
    rng = random.Random(seed)
    texts = ["", " ", None, "\n\t", "Yes.", "no", "why?", "é…", "Oh!  ", "cut off. then", "two. marks! "]
    roles = ["user", "assistant", "system", "tool", "", None, "uncle"]
    rows = []
    for conv in [*range(-3, 60), None]:
        for turn in range(rng.randrange(1, 9)):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, None, turn - 1, 5 * turn]), role, rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}."))
    rows += [(100, t, ("user", "assistant")[t % 2], f"long {t}." if t % 97 else "x" * 200_000) for t in range(3000)]
    rows += [(101, 3, "user", "Same.")] * 40
    rows += [(conv, t, ("user", "assistant")[t], "All alike.") for conv in range(200, 330) for t in (0, 1)]
    return rows


def test_repair_equals_the_contract(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).withColumn("copy", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("audit", F.lit(None)).repartition(7)
    got = {r.conv_id: tuple(r) for r in repair.report(repair.repair(repair.damage(df))).collect()}
    convs = {r[0] for r in rows}
    assert set(got) == convs
    for conv in convs:
        assert got[conv] == plain_report([r[1:] for r in rows if r[0] == conv], conv), conv


def test_repair_of_dropped_and_of_no_turns(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], TURNS)
    (row,) = repair.report(repair.repair(repair.damage(df))).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", sha(""))
    assert repair.report(repair.repair(repair.damage(df.limit(0)))).count() == 0


def test_repaired_turns_follow_the_grammar(spark):
    turns = repair.repair(repair.damage(spark.createDataFrame(conversations(9), TURNS))).collect()
    roles = {}
    for r in turns:
        out = roles.setdefault(r.conv_id, [])
        if r.place:
            out.append(r.role[0])
            assert r.place == len(out)
    assert all(re.match(r"(s?(ua)+)?\Z", "".join(r)) for r in roles.values())


def test_words_over_many_ranges(spark, monkeypatch):
    df = spark.createDataFrame(conversations(), TURNS)
    one = {r.word: tuple(r) for r in repair.solve(repair.words(repair.damage(df))).collect()}
    monkeypatch.setattr(repair, "RANGE", 200)
    many = repair.solve(repair.words(repair.damage(df)))
    assert many.rdd.getNumPartitions() > 3
    assert {r.word: tuple(r) for r in many.collect()} == one
    monkeypatch.setattr(repair, "FREQUENT", 2)  # nearly all words are joined by a shuffle
    assert repair.answers(repair.damage(df)).count() == df.select("conv_id").distinct().count()


# 12

def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own.setdefault(conv, []).append((turn is not None, turn or 0, len(text.encode()).to_bytes(4, "big") + digest, (role, text)))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for path in members:
        children.setdefault(path, 0)
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    for path in members:
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (children[path] == 0)
            saved[path[:d]] = saved.get(path[:d], 0) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
    return {(min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                               sha(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)))) for p, m in members.items()}


def talks(seed=2):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(-23, 400, 2), 10**12, 10**12 + 1, None]:
        for turn in range(rng.randrange(1, 14)):
            rows.append((conv, rng.choice([turn] * 9 + [None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é" * 20, "", None, f"own {conv}"])))
    rows += [(c, 0, "user", f"first {c}") for c in range(1000, 1400)]
    rows += [(c, t, "user", f"the same {t}") for c in range(5000, 5300) for t in range(3)]
    rows += [(7000 + c, t, "user", "deep") for c in range(2) for t in range(700 + c)]
    return rows


@pytest.mark.parametrize("tree", [4 << 20, 3000, 200])
def test_trie_equals_all_prefixes(spark, tree):
    rows = talks()
    df = spark.createDataFrame(rows, TURNS).withColumn("key", F.lit(1)).withColumn("base", F.lit("x")).repartition(5)
    got = turntrie.trie(turntrie.rebuilt(df), tree).collect()
    expected = plain_trie(rows)
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == expected and len(got) == len(expected)


def test_trie_of_plain_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 0, "u", "x"), (2, 0, "u", "x"), (2, 1, "a", "yy"), (None, 0, "u", "x")], TURNS)
    got = {(r.conv_id, r.depth): tuple(r)[2:] for r in turntrie.trie(turntrie.plain(df)).collect()}
    assert got == {(1, 0): (None, 2, 1, 1, 1, sha("")), (1, 1): (1, 2, 1, 1, 1, sha("1")), (2, 2): (1, 1, 0, 1, 0, sha("2"))}
    assert turntrie.trie(turntrie.rebuilt(df.limit(0))).count() == 0


def test_radix_tree_grows_through_all_layouts():
    rng = random.Random(1)
    keys = sorted({bytes([a]) + bytes(rng.randrange(256) for _ in range(turntrie.WIDTH - 1)) * n for a in range(256) for n in (1, 2)})
    keys = [k[:len(k) // turntrie.WIDTH * turntrie.WIDTH] for k in keys]
    order = sorted(set(keys))
    shapes = set()
    for shuffled in (order, rng.sample(order, len(order))):
        root = turntrie.Node(b"")
        for i, k in enumerate(shuffled):
            root.insert(k, (1, i, "e"))
            shapes.add((type(root.kids).__name__, getattr(root.kids, "size", None)))
        found = {n.value[0] for n in root.below() if n.value}
        assert found == set(order)
    assert shapes == {("Few", 4), ("Few", 16), ("Indexed", None), ("Direct", None)}


# 13

def pieces_cases():
    rng = random.Random(7)
    return [None, "", " ", "  ", "a", "  a  ", "a\0b", "x▁y▁▁", "\n\n  \t x", "<s>hi</s><0x0A>", "🙂😀é é", " " * 999, "a" * 5000, "ab" * 999, "▁",
            "no spaces " * 3, "long" * 40_000, *["".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(300)) for _ in range(60)],
            *["".join(rng.choice("aeinrst hlod'  ") for _ in range(200)) for _ in range(100)],
            *["".join(rng.choice(["▁", " ", "  ", "the", "ing", "=", "==", "-", "----", "\n", "é", "0", "00"]) for _ in range(60)) for _ in range(200)]]


def test_pieces_equal_the_library(spark):
    known, cases = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE), pieces_cases()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)] * 2, "doc_id long, text string, ids string")
    coded = pieces.encode(df, PIECE_BPE)
    rows = pieces.decode(coded, PIECE_BPE).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        ids = known.encode(cases[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.ids == ids and r.decoded == known.decode(ids)
    packed = pieces.decode(pieces.encode(df, PIECE_BPE, packed=True, bos=False), PIECE_BPE).orderBy("doc_id").first()
    assert bytes(packed.ids) == (2).to_bytes(4, "little") and packed.decoded == ""
    assert pieces.encode(df.limit(0), PIECE_BPE).count() == 0


def test_any_ids_decode_like_the_library():
    known, rng = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE), random.Random(3)
    dec = pieces.Decoder(pieces.load_model(PIECE_BPE))
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(32_000), 28705, 259]) for _ in range(rng.randrange(9))]
        assert dec.decode(np.array(ids, np.int64), np.array([0, len(ids)])) == [known.decode(ids)], ids
    assert dec.decode(np.array([-1, 99_999, 264]), np.array([0, 0, 3])) == ["", "�� a"]


def test_pairs_by_parts_equal_pairs_by_merges():
    enc, rng = pieces.Encoder(pieces.load_model(PIECE_BPE)), random.Random(4)
    tokens = [i for t, i in enc.ids.items() if len(t) == 1 or t in enc.halves]
    for _ in range(20_000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert enc.compatible(a * enc.base + b) == (pieces.merged(enc.text[a] + enc.text[b], enc.score) == [enc.text[a], enc.text[b]])


def test_models_with_pieces_over_borders_and_letters_without_a_piece():
    """A made-up model: pieces that go on over a space, ties, a letter that is only a part of pieces."""
    made = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    made += [(p, -float(i // 2), 1) for i, p in enumerate(["ab", "b▁", "▁a", "ab▁", "b▁a", "aab", "cd", "bb", "abb"])] + [(c, -99.0 - i, 1) for i, c in enumerate("ab▁d")]
    enc = pieces.Encoder({"pieces": made, "prefix": True, "fallback": False, "unknown": "?"})
    assert enc.apart and enc.loose and enc.odd
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice("aabbcd z") for _ in range(rng.randrange(1, 25)))
        expected = [enc.ids.get(t, 0) for t in pieces.merged(" " + text, enc.score)]
        assert np.frombuffer(enc.encode([text])[0], "<i4").tolist() == expected, text
