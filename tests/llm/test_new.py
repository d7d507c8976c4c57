"""Phrases, online packing and the prefix trie against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from seqloom.llm import common, levels, phrases, trie

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


# Phrases


def brute_phrases(rows, least, longest, best):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        hidden = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= often.get(p[i:j], a + 1)}
        found = []
        for p, a in often.items():
            if p in hidden:
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(found[:best])]
    return out


def odd_texts():
    rng = np.random.default_rng(3)
    words = ["The", "the", "of", "É", "naïve", "好", "x-1", "a b", "it's", "N"]
    rows = [(None, None), ("en", ""), ("en", " \t .,;"), (None, "The of"), ("und", "the OF"), ("de", "a" * 5000), ("fr", "la la la la la la"), ("fr", "la, la. la; la")]
    for lang in ("en", "en", "en", "de", None):
        for size in (3, 40, 900):
            rows.append((lang, "".join(str(rng.choice(words)) + str(rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0b"])) for _ in range(size))))
    return rows + [("en", "New york City of the north.\n" * 60)] * 3


@pytest.mark.parametrize("block", [400, 1 << 20])
def test_phrases(spark, block):
    rows = odd_texts()
    df = spark.createDataFrame([(a, b, 1, 2, "s") for a, b in rows], "lang string, text string, f int, n long, phrase string").repartition(5)
    for least, best in ((2, 2000), (3, 7)):
        got = phrases.collocations(df, least=least, best=best, block=block)
        assert sorted_rows(got.collect()) == sorted_rows(brute_phrases(rows, least, 5, best))
    assert phrases.collocations(df.limit(0)).count() == 0


def test_misra_gries_keeps_every_frequent_key():
    rng = np.random.default_rng(1)
    for least in (5, 20):
        stream = np.concatenate((rng.integers(0, 3000, 6000), np.repeat(np.arange(5000, 5040), least))).astype(np.uint64)
        rng.shuffle(stream)
        parts = [np.unique(p, return_counts=True) for p in np.array_split(stream, 9)]
        summary = phrases.MisraGries(len(stream) // least + 1)
        other = phrases.MisraGries(summary.capacity)
        for i, (k, c) in enumerate(parts):
            (summary if i < 5 else other).merge(k, c)
            assert len(summary.keys) <= summary.capacity
        summary.merge(other.keys, other.counts)
        summary.lost += other.lost
        assert summary.lost * (summary.capacity + 1) <= len(stream) and summary.lost < least
        keys, counts = np.unique(stream, return_counts=True)
        assert set(keys[counts >= least].tolist()) <= set(summary.reaching(least).tolist())


def test_long_texts_are_cut_between_pieces_only():
    text = b"one two three. four five\nsix seven eight nine"
    for long in range(1, 60):
        parts = list(phrases._cut(text, long))
        assert [w for p in parts for w in re.split(rb"[.\n]", p)] == re.split(rb"[.\n]", text)


# Online packing


def test_level_choice_equals_the_sum_of_squares():
    rng = np.random.default_rng(2)
    for capacity in (8, 64):
        packer, fill = levels.Levels(capacity), {}
        for size in rng.integers(1, capacity + 1, 600).tolist():
            counts = Counter(fill.values())

            def cost(level):
                new = Counter(counts)
                if level:
                    new[level] -= 1
                if level + size < capacity:
                    new[level + size] += 1
                return sum(c * c for c in new.values())

            usable = [0] + [h for h in counts if h + size <= capacity]
            window, level, full = packer.place(size)
            assert cost(level) == min(map(cost, usable)) and level == max(h for h in usable if cost(h) == min(map(cost, usable)))
            assert fill.get(window, 0) == level
            fill[window] = level + size
            if full:
                del fill[window]
        assert {h: len(w) for h, w in packer.rest()} == Counter(fill.values())


def check_pieces(rows, want, capacity):
    """want: (doc, ids) of all documents, in any order."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for spans in by_seq.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at and n > 0
            at += n
        assert at <= capacity and at & (at - 1) == 0
    expected = defaultdict(list)
    for doc, ids in want:
        expected[doc, len(ids)].append(np.asarray(ids, "<u4"))
    assert set(by_doc) == set(expected)
    for key, found in by_doc.items():
        assert sum(n for _, n, _ in found) == key[1] * len(expected[key])
        for start, n, crc in found:
            assert any(zlib.crc32(ids[start : start + n].tobytes()) == crc for ids in expected[key])
        if len(expected[key]) == 1:
            assert sorted((s, n) for s, n, _ in found)[0][0] == 0 and sum(1 for _ in found) == len({s for s, _, _ in found})
    return by_seq


@pytest.mark.parametrize("run_ids", [300, 1 << 24])
def test_online_packing(spark, run_ids):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(common.tokenizer_path())
    rng = np.random.default_rng(9)
    texts = [None, "", "", "a", " ".join(["word"] * 5000)] + [" ".join(str(x) for x in rng.integers(0, 99, n)) for n in rng.integers(1, 400, 120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x y"), (3, "a"), (None, None)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, offset int, length string").repartition(3)
    got = levels.pack_online(df, capacity=256, run_ids=run_ids).collect()
    by_seq = check_pieces(got, [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows], 256)
    total = sum(r["length"] for r in got)
    if run_ids > 300:
        assert len(by_seq) <= total // 256 + 3 * 256 and sum(1 for s in by_seq.values() if sum(n for _, n in s) == 256) >= 0.9 * (total // 256)
    assert levels.pack_online(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        levels.pack_online(df, capacity=100)


# Prefix trie


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for t in turns.values():
        t.sort()
    members = defaultdict(list)
    ends = defaultdict(list)
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - int(np.fmod(conv, 20))
        rebuilt = tuple(x[2:] for x in turns.get(base, [])[:h] + own[h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(conv)
        ends[rebuilt].append(conv)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0) for q in below)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), kids[p], sum(not kids[q] for q in below), saved, digest))
    return out


TURNS = "conv_id long, turn int, role string, text string, depth string, a int, end long"


def odd_turns():
    rng = np.random.default_rng(11)
    rows = []
    for conv in [*range(0, 70), 100, 113, -1, -7, -20, -33, 1003]:
        if conv in (20, 41):
            continue
        n = int(rng.integers(1, 7))
        rows += [(conv, t, ["user", "bot", None][int(rng.integers(0, 3))], str(rng.choice(["hi there", "yes", "", "no way  out", "ok\nfine"]))) for t in range(n)]
    rows += [(7, None, "user", "first"), (7, None, None, None), (8, 9, "user", "tie"), (8, 9, "bot", "tie"), (None, 1, "user", "lost")]
    rows += [(60 + k, 0, "zed", "same") for k in range(20)] * 2  # repeated rows
    rows += [(2000, t, "user", f"w{t % 5} x") for t in range(400)]  # a long conversation
    rows += [(2000 + k, t, "user", f"w{t % 5} x") for k in (1, 2, 3, 4) for t in range(100 * k)]
    rows += [(3000 + k, 1, "user", "again") for k in range(150)]  # many that end at one node
    return rows


@pytest.mark.parametrize("sizes", [(7, 5, 3), (1 << 16, 1 << 14, 1 << 12)])
def test_prefix_trie(spark, sizes):
    rows = odd_turns()
    df = spark.createDataFrame([(*r, "d", 1, 2) for r in rows], TURNS).repartition(6).cache()
    bundle, most, stretch = sizes
    got = trie.prefix_trie(df, bundle=bundle, most=most, stretch=stretch)
    assert sorted_rows(got.collect()) == sorted_rows(brute_trie(rows))
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_a_trie_without_turns(spark):
    # Conversations 1, 2, 3 have fewer turns than are taken over and no first conversation to take them from.
    rows = [(c, 0, "user", "x") for c in (41, 42, 43, 44, 45)]
    got = trie.prefix_trie(spark.createDataFrame([(*r, "d", 1, 2) for r in rows], TURNS))
    assert sorted_rows(got.collect()) == sorted_rows(brute_trie(rows))


def test_maps_of_parts_join():
    rng = np.random.default_rng(5)
    steps = [(int(a) | 1, int(c)) for a, c in rng.integers(0, 1 << 63, (20, 2))]
    whole = trie.EMPTY
    for s in steps:
        whole = trie.then(whole, s)
    left, right = trie.EMPTY, trie.EMPTY
    for s in steps[:8]:
        left = trie.then(left, s)
    for s in steps[8:]:
        right = trie.then(right, s)
    assert trie.then(left, right) == whole and trie.then(trie.undo(left), whole) == right and trie.then(left, trie.undo(left)) == trie.EMPTY
