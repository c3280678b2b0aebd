"""The text operators against brute force, on small tables with nulls, empty and long texts, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyspark.llm import bpe, components, jaccard, mixing, mpegts, pieces, ppm, quality, secrets, suffixes, toxicity

TOKENIZERS = os.environ.get("TALLYSPARK_TOKENIZERS", "/opt/tokenizers")
SCHEMA = "doc_id long, text string, n long, a string, part int, __x string"


def odd_texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    base = [" ".join(word() for _ in range(rng.randint(3, 150))) for _ in range(8)]
    out = [None, "", " \t\n", "One two", "one TWO", "one two three", "ab " * 400, "q" * 3000, "x\x00y 日本語 🎉\r\n z"]
    for t in base:
        w = t.split()
        out += [t, t, t.upper(), " ".join([*w[:5], "new", *w[6:]]), " ".join(w[: len(w) * 4 // 5]), t + "\n" + base[0]]
    return out


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "a", 0, None) for i, t in enumerate(texts)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_jaccard(spark, docs, texts, empty):
    sets = [set(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set() for w in map(words, texts)]
    parent = list(range(len(sets)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = by_id(jaccard.join(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert jaccard.join(empty).count() == 0


def test_jaccard_null_and_repeated_ids(spark):
    t = "a b c d e f g h"
    rows = spark.createDataFrame([(None, t), (3, t), (3, t), (2, t), (9, "")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in jaccard.join(rows).collect() if r.doc_id) == [(2, 2), (3, 2), (3, 2), (9, 9)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_suffixes(docs, texts, empty):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    got = by_id(suffixes.dedup(docs))
    for i, t in enumerate(data):
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - 199):
            if seen[t[j : j + 200]] > 1:
                gone[j : j + 200] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        assert tuple(got[i])[1:] == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert suffixes.dedup(empty).count() == 0


def test_ppm(spark, docs, texts, empty):
    order, train = ppm.ORDER, lambda i: i % 4 > 0
    seen = collections.defaultdict(collections.Counter)
    tokens, lower = collections.Counter(), [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode() for t in texts]
    for i, t in enumerate(lower):
        if train(i):
            tokens.update(words(texts[i]) + [None])
            b = bytes(order) + t + b"\xff"
            for k in range(order, len(b)):
                for j in range(order + 1):
                    seen[b[k - j : k]][b[k]] += 1
    n, v = sum(tokens.values()), len(tokens)
    got = by_id(ppm.score(docs, F.col("doc_id") % 4 > 0))
    for i, t in enumerate(lower):
        b, total = bytes(order) + t + b"\xff", 0.0
        for k in range(order, len(b)):
            out = set()
            for j in range(order, -1, -1):
                c = {s: m for s, m in seen.get(b[k - j : k], {}).items() if s not in out}
                if not c:
                    continue
                if b[k] in c:
                    total += math.log10(c[b[k]] / (sum(c.values()) + len(c)))
                    break
                total += math.log10(len(c) / (sum(c.values()) + len(c)))
                out |= set(c)
            else:
                total -= math.log10(256 - len(out))
        w = [*words(texts[i]), None]
        assert got[i].score == pytest.approx(total, abs=1e-3)
        assert got[i].base_score == pytest.approx(sum(math.log10((tokens[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(x in tokens for x in w), n)
    assert ppm.score(empty, F.lit(True)).count() == 0
    assert ppm.score(docs, F.lit(False)).where("score > 0 OR n_known > 0").count() == 0


def test_ppm_keeps_all_contexts(spark, monkeypatch):
    """More different contexts than the bound there was; in many small blocks, whose lists are merged by level."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, 50_000))) for _ in range(20)]
    texts.append("".join(t[i : i + 12] for i, t in zip(range(0, 4000, 200), texts, strict=True)))
    wide = [np.frombuffer(bytes(5) + t.encode() + b"\xff", np.uint8).astype(np.uint64) for t in texts]
    strings = [sum(w[j : len(w) - 5 + j] << np.uint64(8 * (5 - j)) for j in range(6)) for w in wide]
    seen, total = np.concatenate(strings[:-1]), 0.0
    after = [{} for _ in range(6)]
    for s in strings[-1]:
        out = set()
        for j in range(5, -1, -1):
            context = (s >> np.uint64(8)) & np.uint64((1 << 8 * j) - 1)
            if context not in after[j]:
                symbols = seen[((seen >> np.uint64(8)) & np.uint64((1 << 8 * j) - 1)) == context] & np.uint64(255)
                after[j][context] = dict(zip(*(x.tolist() for x in np.unique(symbols, return_counts=True)), strict=True))
            c = {k: n for k, n in after[j][context].items() if k not in out}
            if not c:
                continue
            if int(s) & 255 in c:
                total += math.log10(c[int(s) & 255] / (sum(c.values()) + len(c)))
                break
            total += math.log10(len(c) / (sum(c.values()) + len(c)))
            out |= set(c)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = by_id(ppm.score(docs, F.col("doc_id") < 20))
    assert whole[20].score == pytest.approx(total, abs=1e-2)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(ppm, "FAN_IN", 3)
    cut = by_id(ppm.score(docs, F.col("doc_id") < 20))
    assert all(cut[i].score == pytest.approx(whole[i].score, rel=1e-9) for i in whole)


def test_bpe(docs, texts, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    t = tokenizers.Tokenizer.from_file(path)
    c = bpe.Coder(path)
    more = [x or "" for x in texts] + [" a<|endoftext|> b <|endoftext|>", "aaaa" * 99, "don't  \n\n x", "İıſK"]
    for x, ids in zip(more, c.encode(more), strict=True):
        want = t.encode(x, add_special_tokens=False).ids
        assert ids.tolist() == want and c.decode(ids) == t.decode(want, skip_special_tokens=False)
    got = by_id(bpe.round_trip(docs, path))
    assert all(r.same and r.decoded_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest() for i, r in got.items())
    assert by_id(bpe.decode(bpe.encode(docs, path), path))[8].text == texts[8]
    assert bpe.round_trip(empty, path).count() == 0


def test_pieces():
    rng = random.Random(1)

    def brute(w, vocabulary):
        n = 0
        while w:
            k = next((k for k in range(len(w), 0, -1) if w[:k] in vocabulary), 0)
            if not k:
                return 1
            w, n = w[k:], n + 1
        return n

    for _ in range(200):
        vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 9))}
        ws = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) for _ in range(20)]
        ends = np.cumsum([len(w) for w in ws])
        starts = ends - [len(w) for w in ws]
        assert pieces.Automaton(list(vocabulary)).count(np.frombuffer(b"".join(ws), np.uint8), starts, ends).tolist() == [brute(w, vocabulary) for w in ws]


def test_transport_streams(docs, texts, empty):
    streams = mpegts.transport_streams(docs)
    got = by_id(mpegts.digests(streams))
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes % 188 == 0 and r.cc_errors == 0
    packets = mpegts.elementary_packets(streams)
    assert packets.where("random_access AND unit % 8 <> 0 OR pts < 0 OR bad_tables > 0").count() == 0
    assert packets.groupBy().sum("n_bytes").first()[0] == sum(r.payload_bytes for r in got.values())
    whole = mpegts.mux(np.arange(576 * 20).astype(np.uint8)).reshape(-1, 188)
    assert mpegts.demux(np.delete(whole, 7, 0).ravel()).cc_errors == 1
    assert mpegts.digests(mpegts.transport_streams(empty)).count() == 0


def test_secrets(spark, empty):
    rng = random.Random(2)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'é word token = "{key(40)}" and AKIA{key(16).upper()} Passwd:short api-key: x1 apikey=abcdef') for i in range(60)]
    rows += [(100, None), (101, ""), (102, "plain words only"), (103, f"é seen {key(20)} alone")]
    rows += [(200 + i, f"see site{i}.example.com/page-{i}.html and Report_{i}_Final.docx") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(secrets.spans(frame, secrets.learn(frame), redact="[S]"))
    for i, t in rows:
        found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in secrets.ASSIGN.finditer(t or "") if len(m[2]) >= 6]
        found += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, name, p in ((1, "access", r"AKIA[A-Z0-9]+"), (2, "hex", r"[0-9a-f]+")) for m in re.finditer(p, t or "") if len(m[0]) >= secrets.LEAST[name]]
        assert got[i].base_spans == ",".join(x[2] for x in sorted(found))
        assert set(filter(None, got[i].base_spans.split(","))) <= set(got[i].spans.split(","))
    assert got[103].n_auto == 1 and got[102].spans == "" and got[100].redacted is None
    assert secrets.spans(empty, {}).count() == 0


def test_quality_counts(docs, texts, empty):
    got = by_id(quality.quality(docs, quality.Chain()))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        hit = {j + k for j in range(len(w) - 4) if at[tuple(w[j : j + 5])] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
    assert quality.quality(empty, quality.Chain()).count() == 0


def test_chain_decodes_best_path():
    rng = np.random.default_rng(3)
    chain = quality.Chain(rng.normal(size=(quality.N_BINS, 2)), rng.normal(size=2), rng.normal(size=(2, 2)))
    doc = np.repeat([0, 1, 2], [7, 1, 4])
    bins = rng.integers(0, quality.N_BINS, (len(doc), len(quality.GROUPS)))
    unary = chain.weights[bins].sum(1)
    labels = chain.viterbi(bins, doc)
    for d in range(3):
        u = unary[doc == d]
        score = lambda y, u=u: chain.start[y[0]] + sum(u[t, y[t]] for t in range(len(y))) + sum(chain.step[a, b] for a, b in zip(y, y[1:], strict=False))
        assert tuple(labels[doc == d]) == max(itertools.product((0, 1), repeat=len(u)), key=score)


def test_toxicity_learns_pairs():
    rng = np.random.default_rng(0)
    doc, term, label = [], [], []
    for i in range(2000):
        a, b = rng.random(2) < 0.5
        label.append(float(a and b))
        mine = [1] * int(a) + [2] * int(b) + rng.integers(100, 400, 10).tolist()
        doc += [i] * len(mine)
        term += mine
    both = np.unique(np.array(doc) * (1 << 20) + np.array(term))
    machine = toxicity.fit(both >> 20, both & ((1 << 20) - 1), np.array(label))
    z = machine.margin(both >> 20, both & ((1 << 20) - 1), 2000)
    assert ((z > 0) == np.array(label)).mean() > 0.97


def test_toxicity_edges(docs, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, labels)
    assert toxicity.toxicity(docs, machine).where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.toxicity(empty, machine).count() == 0


def test_mixture(spark, empty):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)) if i % 50 else None, rng.choice(["en", "de"]), rng.choice(["s0"] * 6 + ["s1", "s2", None])) for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    weights = {"lang": F.when(F.col("mix_lang") == "en", 3).otherwise(1), "source": F.lit(1)}
    out = mixing.mix(frame, levels, weights, budget=30_000, epochs=2).collect()
    supply = collections.Counter()
    for _, t, lang, source in rows:
        supply[lang, source or "(none)"] += len((t or "").split())
    want = {}

    def fill(amount, caps, ws):
        """Water-filling by trying every level in turn."""
        take, open_ = dict.fromkeys(caps, 0.0), set(caps)
        while open_ and amount > 1e-9:
            level = amount / sum(ws[c] for c in open_)
            full = {c for c in open_ if caps[c] <= level * ws[c] + 1e-9}
            for c in full or open_:
                take[c] = caps[c] if full else level * ws[c]
            if not full:
                break
            amount -= sum(caps[c] for c in full)
            open_ -= full
        return take

    caps = {lang: 2 * sum(v for k, v in supply.items() if k[0] == lang) for lang in ("en", "de")}
    for lang, amount in fill(30_000, caps, {"en": 3, "de": 1}).items():
        leaves = {k: 2 * v for k, v in supply.items() if k[0] == lang}
        want |= fill(amount, leaves, dict.fromkeys(leaves, 1))
    got = collections.Counter()
    for r in out:
        got[r.mix_lang, r.mix_source] += r.mix_tokens * r.mix_copies
    for leaf, amount in want.items():
        assert amount - 30 <= got[leaf] <= amount + 1e-6
    again = mixing.mix(frame.repartition(7), levels, weights, budget=30_000, epochs=2).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix(empty.drop("__x").withColumn("lang", F.lit("a")).withColumn("source", F.lit("b")), levels, weights).count() == 0


def linked_components(rows):
    """Components of (id, text) by brute force over all pairs."""
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set()) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            up[y] = x
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("often", [True, False])
def test_jaccard_regroups_large_groups(spark, monkeypatch, often):
    """Texts that share a passage and mostly don't link, near copies of some of them, sizes that differ: the same components by groups of their own."""
    monkeypatch.setattr(jaccard, "DIRECT", 0)
    if not often:
        monkeypatch.setattr(jaccard, "frequent", lambda *a, **k: (np.zeros(0, np.uint64), np.zeros(0, np.uint8)))
    rng = random.Random(11)
    shared = [f"s{i}" for i in range(20)]
    base = [shared[: rng.randint(8, 20)] + [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 60))] for _ in range(60)]
    near = [w[: rng.randint(int(len(w) * 0.7), len(w))] + [f"n{rng.randint(0, 9)}" for _ in range(rng.randint(0, 8))] for w in base for _ in range(2)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base + near)] + [(500, ""), (501, None)]
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = linked_components(rows)
    assert got == want and 60 < len(set(want.values())) < 180


def test_jaccard_ids_with_several_texts_in_one_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "DIRECT", 0)
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, b + " x"), (3, a + " y"), (4, c), (5, c + " z")]
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
