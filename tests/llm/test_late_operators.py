"""Packed ids, prefix tries and filter audits against brute force."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tallyspark.llm import interactions, packed, tries
from tallyspark.llm.queries import tokenizer

WORD_BPE = tokenizer("word_bpe_49k.json")


# ---- packed ids


@pytest.mark.parametrize("n", [0, 1, 2, 59, 60, 61, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("bits", [0, 1, 5, 16, 31, 60, 63])
def test_words_give_the_ids_back(n, bits):
    rng = np.random.default_rng(n + bits)
    ids = rng.integers(0, max(1, 1 << bits), n, dtype=np.uint64)
    ids[rng.integers(0, n, n // 50) if n else []] = 2**64 - 1  # escapes
    begins, words, escapes = packed.pack(ids)
    assert (packed.unpack(n, begins, words, escapes) == ids).all()
    assert len(begins) == -(-n // packed.BLOCK) and len(escapes) == (ids >> np.uint64(60) > 0).sum()


def test_each_word_holds_the_most_ids_that_fit():
    rng = np.random.default_rng(1)
    ids = rng.geometric(0.001, 2500)
    begins, words, _ = packed.pack(ids)
    at, taken = 0, []
    for start in range(0, len(ids), packed.BLOCK):
        block = ids[start : start + packed.BLOCK]
        taken.append(at)
        while len(block):
            k = next(k for s, k in enumerate(packed.COUNTS.tolist()) if s and all(int(x) >> int(packed.BITS[s]) == 0 for x in block[:k]))
            assert packed.COUNTS[int(words[at]) >> 60] == k
            block, at = block[k:], at + 1
    assert at == len(words) and begins.tolist() == taken


def test_broken_files_are_refused():
    data = packed.image(np.array([5, 6, 7]), np.array([1, 2]), ["a", None], 3, 9)
    ids, lengths, names, shard, before = packed.opened(data)
    assert (ids.tolist(), lengths.tolist(), names, shard, before) == ([5, 6, 7], [1, 2], ["a", None], 3, 9)
    with pytest.raises(ValueError):
        packed.opened(b"x" + data[1:])
    with pytest.raises(ValueError):
        packed.opened(data[:10])
    with pytest.raises(ValueError):
        packed.unpack(1, np.array([0]), np.array([15 << 60], np.uint64), np.zeros(0, np.uint64))


def odd_texts():
    rng = random.Random(9)
    words = ["it's", "don't", "É", "éx", "<|endoftext|>", "a<|startoftext|>b", "日本語", "🎉", "Straße", "ΣΑΣ", "İstanbul", "ſo.", "ʼNa!?", "x" * 300, "12345", "--!", "́", " q", "Hello"]
    return [None, "", " \t\n", *words, *["".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t", " ", "\x1c", "\u0085", ""]) for _ in range(rng.randint(1, 400))) for _ in range(30)], "long words " * 30_000, "same", "same"]


def library_ids(texts):
    from tokenizers import Tokenizer

    return [[*x.ids, 1] for x in Tokenizer.from_file(WORD_BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packed_files_against_the_library(spark, monkeypatch, tmp_path):
    texts = odd_texts()
    docs = spark.createDataFrame([(i * 7 % 53, t, 0, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, shard int, content string, __row int").repartition(4)
    files = packed.write(docs, WORD_BPE)
    got = sorted(tuple(r) for r in packed.read_back(files).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    want, start = [], 0
    for i, ids in sorted((i * 7 % 53, ids) for i, ids in enumerate(library_ids(texts))):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert sorted((r.doc_id, r.ids) for r in packed.ids(files).collect()) == sorted((i * 7 % 53, ids) for i, ids in enumerate(library_ids(texts)))
    assert packed.export(files, str(tmp_path / "out")).count() == files.count()
    again = packed.load(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in packed.read_back(again).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_packed_repeats_null_ids_and_names(spark):
    rows = [(None, "no id"), (None, None), ("b", "x y"), ("a", "same"), ("a", "same"), ("a", "other")]
    files = packed.write(spark.createDataFrame(rows, "doc_id string, text string"), WORD_BPE)
    got = [tuple(r) for r in packed.read_back(files, "string").orderBy("start").collect()]
    assert [r[0] for r in got] == [None, None, "a", "a", "a", "b"] and [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    of = {"no id": 1, None: 1, "x y": 1, "same": 2, "other": 1}
    assert collections.Counter((r[0], r[2], r[3]) for r in got) == collections.Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, library_ids([t for _, t in rows]), strict=True)) and of
    none = packed.read_back(packed.write(spark.createDataFrame([], "doc_id long, text string"), WORD_BPE))
    assert none.count() == 0 and none.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_several_files_a_shard():
    ids, sizes = packed.coder(WORD_BPE).encode(pa.array(["a b c", "", "a b"]), 1)
    assert sizes.tolist() == [4, 1, 3] and ids.tolist() == sum(library_ids(["a b c", "", "a b"]), [])


# ---- prefix tries


def brute_trie(seqs):
    """seqs: conv_id -> list of (role, text)."""
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        m = sorted(members[p])
        kids = [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
        ends = ",".join(str(c) for c in m if len(seqs[c]) == len(p))
        own = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        out[p] = (m[0], len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), sum(out[k][5] for k in kids) or 1, own + sum(out[k][6] for k in kids), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 60), 1000, 1003, -7]:
        if rng.random() < 0.1:
            continue
        long = rng.random() < 0.15
        text = [("user", "hi"), ("assistant", "é" * 3), ("user", ""), (None, None), ("user", "x"), ("user", "y")]
        for k in range(rng.choice([1, 2, 3, 5]) if not long else 30):
            role, t = ("user", "again") if long and k < 25 else rng.choice(text)
            rows.append((c, k - 1 if k else None, role, t))
    return rows


def ordered(rows):
    out = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    return {c: [(r, t) for _, r, _, t in sorted(x, key=lambda y: y[:3])] for c, x in out.items()}


def rebuild(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = seqs.get(base, [])[:h] + own[h:]
    return out


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("local", [0, 12, 40, 1 << 14])
def test_trie_against_brute_force(spark, local):
    rows = conversations(local)
    docs = spark.createDataFrame([(*r, 1, "a") for r in rows], TURNS + ", node int, id string").repartition(3)
    columns = tries.NODE.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((tuple(r) for r in tries.prefix_trie(docs, local).select(*columns).collect()), key=str) == brute_trie(ordered(rows))
    assert sorted((tuple(r) for r in tries.rebuilt_trie(docs, local).select(*columns).collect()), key=str) == brute_trie(rebuild(ordered(rows)))


def test_trie_of_one_deep_prefix_takes_few_rounds(spark, monkeypatch):
    """All members share 50 turns, then part; equal ones end together. The shared part is skipped, not dealt turn by turn."""
    deep = [(c, k, "user", f"t{k}" if k < 50 else f"c{c % 3}") for c in range(12) for k in range(52)]
    dealt = []
    shared = tries._shared
    monkeypatch.setattr(tries, "_shared", lambda *a: dealt.append(1) or shared(*a))
    got = tries.prefix_trie(spark.createDataFrame(deep, TURNS), 20)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(ordered(deep))
    assert len(dealt) < 8


def test_trie_repeats_null_ids_and_empty_table(spark):
    rows = [(None, 1, "u", "x"), (4, None, None, None), (4, None, None, None), (4, 2, "u", "b"), (4, 2, "u", "a"), (9, 7, "", ""), (9, 8, "", "")]
    got = tries.prefix_trie(spark.createDataFrame(rows, TURNS), 1)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(ordered(rows))
    none = tries.rebuilt_trie(spark.createDataFrame([], TURNS))
    assert none.count() == 0 and len(none.columns) == 8


def test_a_long_conversation_is_numbered_over_many_tasks(spark):
    rows = [(5, k, "u", "same" if k % 2 else f"{k}") for k in range(3000)] + [(6, 0, "u", "x")]
    random.Random(2).shuffle(rows)
    got = tries.numbered(spark.createDataFrame(rows, TURNS).repartition(6)).orderBy("conv_id", "pos").collect()
    assert [r.pos for r in got] == [*range(3000), 0] and [r.bytes for r in got[:3000]] == [len("same" if k % 2 else f"{k}") for k in range(3000)]


# ---- filter audits


def brute_audit(rows, names):
    """rows: part, set of failed filters, good, toxic."""
    out = []
    parts = collections.defaultdict(list)
    for r in rows:
        parts[r[0]].append(r[1:])
    for part, docs in parts.items():
        removed = collections.Counter()
        lines = []
        for order in itertools.permutations(names):
            left = docs
            for i, f in enumerate(order):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                removed[f] += len(gone)
                fails = [d for d in docs if f in d[0]]
                lines.append((part, "".join(order), i + 1, len(left), len(gone), len(fails) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*x[:-1], removed[x[-1]]) for x in lines]
    return sorted(out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("names", ["A", "AB", "XYZW", "ABCDE"])
def test_audit_against_brute_force(spark, names):
    rng = random.Random(len(names))
    rows = [(rng.choice(["p", "q", ""]), {f for f in names if rng.random() < 0.4}, rng.random() < 0.5, rng.random() < 0.2) for _ in range(200)]
    table = spark.createDataFrame([(p, *[f in s for f in names], g, t) for p, s, g, t in rows], "part string, " + ", ".join(f"fails_{f} boolean" for f in names) + ", good boolean, toxic boolean")
    assert sorted(tuple(r) for r in interactions.audit(table, list(names)).select(*AUDIT).collect()) == brute_audit(rows, names)


def test_audit_shares_states_and_gives_them_back(spark, monkeypatch):
    counted = []
    count = interactions._counts
    monkeypatch.setattr(interactions, "_counts", lambda rows, done, names: counted.append(done) or count(rows, done, names))
    table = spark.createDataFrame([("p", True, False, True, True, False)], "part string, fails_A boolean, fails_B boolean, fails_C boolean, good boolean, toxic boolean")
    interactions.audit(table, list("ABC")).collect()
    assert len(counted) == len(set(counted)) == 7
    with pytest.raises(ValueError):
        interactions.audit(table, ["A", "BC"])


def test_audit_of_odd_documents(spark):
    texts = [(1, None, None), (2, "", "s"), (3, "", "s"), (None, "", "s"), (4, "word " * 60, "s"), (4, "word " * 60, "s"), (5, "word " * 60, None), (6, " ".join(f"w{i}" for i in range(50)), "s"), (7, "ABC $", "s"), (8, "É é x", "t")]
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (5, 1, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, t, s, "x", True) for i, t, s in texts], "doc_id long, text string, source string, part string, fails_A boolean")
    flags = interactions.flags(docs, labels)
    seen = collections.defaultdict(list)
    for i, t, _ in texts:
        if i is not None:
            seen[t or ""].append(i)

    def failed(i, t):
        t = t or ""
        words = [w for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w]
        rules = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and min(seen[t]) < i}
        return {k for k, v in rules.items() if v}

    rows = [(s or "", failed(i, t), i in (3, 5), i == 3) for i, t, s in texts]
    assert sorted(tuple(r) for r in interactions.audit(flags, list("ABCDE")).select(*AUDIT).collect()) == brute_audit(rows, "ABCDE")
    assert interactions.audit(interactions.flags(docs.limit(0), labels), list("ABCDE")).count() == 0
    assert interactions.flags(docs.withColumn("doc_id", F.col("doc_id").cast("string")), labels).where("good").count() == 2
